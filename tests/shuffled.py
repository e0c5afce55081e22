"""How much a query shuffles: rows and bytes that its stages write for other stages."""


def shuffled(spark, run):
    """(rows, bytes) written to shuffles while ``run()`` runs."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        it = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None).iterator()
        held = {}
        while it.hasNext():
            s = it.next()
            held[(s.stageId(), s.attemptId())] = s.shuffleWriteRecords(), s.shuffleWriteBytes()
        return held

    before = stages()
    run()
    new = [v for k, v in stages().items() if k not in before]
    return sum(r for r, _ in new), sum(b for _, b in new)
