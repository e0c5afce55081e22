"""Secrets, and who owns them: candidates are told apart by how many repositories and owners share them.

DataFrame functions only. Candidates are found by pattern in whole texts; places are code points,
computed from the lengths of what lies between the matches. Each candidate's value is hashed and the
hashes are aggregated over the corpus by distinct owner and by distinct repository: a value that many
owners hold in many repositories is a copied example, one of a single owner looks live. How many is many
follows from the corpus: copies of files carry values to a second owner or repository, to a third and so on, at
a rate that falls by about the same factor each time; a value is an example where that rate leaves less than
one such value to be expected. The base kinds (assign, access, hex) are always reported; the method adds spans of
kind ``owned``: high-entropy strings, bare or as the value of an assignment, that are no access or hex span and that ownership
doesn't show to be examples.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annulus.llm.common import durable

# fixed values: the base patterns. {24,} and {16,} find the same matches as + with the shorter ones dropped
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BARE = r"[A-Za-z0-9+/_=-]{24,}"
KINDS = ("assign", "access", "hex", "owned")
MASK = "[SECRET]"
ANY = "|".join([ASSIGN, ACCESS, BARE])


def _found(text: Column, pattern: str, kind: int, group: int) -> Column:
    """array<struct(kind, i, gap, len, value)>: for each match the length before it (from the match before) and its own."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    rows = F.transform(
        F.arrays_zip(hits.alias("hit"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), values.alias("value")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).cast("long").alias("gap"), F.length(x["hit"]).cast("long").alias("len"), x["value"].alias("value")),
    )
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:bigint,len:bigint,value:string>>"))


def candidates(docs: DataFrame, owner: str, repo: tuple[str, ...]) -> DataFrame:
    """One row for each candidate: rid (a row of docs), doc_id, th (hash of the text), who, repo, kind, start, stop, h, vlen.

    rid tells repeated rows apart. Texts in which no pattern occurs are left out before anything is
    exploded; each other text also has a row of kind -1, so it stays known whatever is dropped later.
    """
    mark = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("i"), F.lit(0).cast("long").alias("gap"), F.lit(0).cast("long").alias("len"), F.lit(None).cast("string").alias("value")))
    t = F.col("__t")
    held = docs.select(
        F.col("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("__t"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("who"),
        F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo]).alias("repo"),
    ).where(t.rlike(ANY)).withColumn("rid", F.monotonically_increasing_id())  # before the explosion, so that a text's rows share it
    rows = held.select(
        "rid", "doc_id", F.xxhash64(t).alias("th"), "who", "repo",
        F.explode(F.concat(_found(t, ASSIGN, 0, 2), _found(t, ACCESS, 1, 0), _found(t, HEX, 2, 0), _found(t, BARE, 3, 0), mark)).alias("x"),
    ).select("rid", "doc_id", "th", "who", "repo", "x.*")
    # a window holds one text's matches of one kind
    upto = "sum(gap + len) over (partition by rid, kind order by i rows between unbounded preceding and current row)"
    v, bare = F.col("value"), F.col("kind") == 3
    placed = rows.withColumn("stop", F.expr(upto)).withColumn("start", F.col("stop") - F.col("len"))
    good = F.when(F.col("kind") == 0, F.length(v) >= 6).when(
        bare, v.rlike("[0-9]") & v.rlike("[A-Za-z]") & ~v.rlike(f"^{HEX}$") & ~v.rlike(f"^{ACCESS}$") & (F.size(F.array_distinct(F.split(v, ""))) >= 10)
    ).otherwise(True)
    return placed.where(good).select("rid", "doc_id", "th", "who", "repo", "kind", "start", "stop", F.xxhash64("value").alias("h"), F.length("value").alias("vlen"))


def ownership(found: DataFrame) -> DataFrame:
    """(h, vlen, owners, repos, n): distinct owners and repositories of each value, and how often it occurs.

    A value that fills the corpus is reduced to one row for each repository before the first shuffle
    and to sums before the second.
    """
    by_repo = found.where("kind >= 0").groupBy("h", "vlen", "who", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("h", "vlen", "who").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("h", "vlen").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("n"))


def many(held: DataFrame, count: str, least: int = 3) -> int:
    """How many owners (or repositories) chance copies don't reach, at least ``least``.

    The rate r at which values are carried on is that of the values with two owners to those with one, at most a half;
    values that are widely copied don't enter it. Of v values, v r^(k - 1) are expected to have k owners or more; the
    result is the first k at which that is below one.
    """
    is_ = lambda n: F.coalesce(F.sum(F.when(F.col(count) == n, 1).otherwise(0)), F.lit(0))
    v, one, two = held.agg(F.count("*"), is_(1), is_(2)).first()
    rate = min(two / one, 0.5) if one else 0.0
    return max(least, 2 + math.floor(math.log(v) / -math.log(rate) + 1e-9)) if rate and v else least


def judged(docs: DataFrame, *, owner: str = "source", repo: tuple[str, ...] = ("source", "lang"), live_owners: int = 1, example_owners: int | None = None, example_repos: int | None = None) -> DataFrame:
    """Candidates with owners, repos and verdict: example (many owners and many repositories, by ``many`` unless given), live (at most
    live_owners owners and no example), else shared. Rows of kind ``owned`` are kept unless the value is an example.

    Rows of kind -1 have no value and no verdict; they take no part in the join.
    """
    found = durable(candidates(docs, owner, repo))
    held = durable(ownership(found))
    owners = many(held, "owners") if example_owners is None else example_owners
    repos = many(held, "repos") if example_repos is None else example_repos
    example = (F.col("owners") >= owners) & (F.col("repos") >= repos)
    verdict = F.when(example, "example").when(F.col("owners") <= live_owners, "live").otherwise("shared")
    values = found.where("kind >= 0").join(held.select("h", "vlen", "owners", "repos", verdict.alias("verdict")), ["h", "vlen"])
    marks = found.where("kind < 0").withColumns({"owners": F.lit(None).cast("bigint"), "repos": F.lit(None).cast("bigint"), "verdict": F.lit(None).cast("string")})
    return values.where((F.col("kind") < 3) | (F.col("verdict") != "example")).unionByName(marks)


def _name(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), kind + 1)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", _name(x["kind"]), x["start"], x["stop"])), ",")


def secrets(docs: DataFrame, **judging) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared, n_example, ownership: one row for each row of ``docs``.

    ownership lists the spans in their order as 'verdict:owners:repositories', comma-joined.
    Null text counts as empty: no span, and base_sha256 is that of the empty string. Null owner or
    repository columns count as one unnamed owner. Repeated rows are reported each; their values
    still count one owner. Extra columns are ignored, whatever their names.
    """
    span = F.struct("start", "kind", "stop")
    owned = F.struct("start", "kind", "stop", "verdict", "owners", "repos")
    said = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["verdict"], x["owners"], x["repos"])), ",")
    n = lambda when, name: F.sum(F.when(when, 1).otherwise(0)).cast("long").alias(name)
    kind = F.col("kind")
    some = (
        judged(docs, **judging)
        .groupBy("rid")
        .agg(
            F.first("doc_id").alias("doc_id"), n(kind == 0, "n_assign"), n(kind == 1, "n_access"), n(kind == 2, "n_hex"),
            F.collect_list(F.when((kind >= 0) & (kind < 3), span)).alias("base"), F.collect_list(F.when(kind >= 0, span)).alias("every"),
            n(F.col("verdict") == "live", "n_live"), n(F.col("verdict") == "shared", "n_shared"), n(F.col("verdict") == "example", "n_example"), F.collect_list(F.when(kind >= 0, owned)).alias("said"),
        )
        .select("rid", "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"), "n_live", "n_shared", "n_example", said(F.col("said")).alias("ownership"))
    )
    zero = lambda *names: [F.lit(0).cast("long").alias(c) for c in names]
    plain = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("__t")).where(~F.col("__t").rlike(ANY))
    rest = plain.select("doc_id", *zero("n_assign", "n_access", "n_hex"), F.sha2(F.lit("").cast("binary"), 256).alias("base_sha256"), F.lit("").alias("spans"), *zero("n_live", "n_shared", "n_example"), F.lit("").alias("ownership"))
    return rest.unionByName(some.drop("rid"))


def redacted(docs: DataFrame, **judging) -> DataFrame:
    """``docs`` with every secret but the copied examples masked in text, all else as it was.

    A column n_chars, if there is one, is set to the masked text's length. Overlapping spans become one mask. Texts without secrets keep null or their value untouched.
    Rows are matched by id and text, so repeated rows are masked alike. An empty table stays empty.
    """
    w = "over (partition by doc_id, th order by start, stop rows between unbounded preceding and 1 preceding)"
    spans = judged(docs, **judging).where("kind >= 0 and verdict <> 'example'").select("doc_id", "th", "start", "stop").distinct()
    gaps = spans.withColumn("done", F.expr(f"coalesce(max(stop) {w}, 0)")).groupBy("doc_id", "th").agg(
        F.array_sort(F.collect_list(F.when((F.col("start") >= F.col("done")) | (F.col("done") == 0), F.struct(F.col("done").alias("a"), F.col("start").alias("b"))))).alias("gaps"), F.max("stop").alias("last")
    )
    held = gaps.select(F.col("doc_id").alias("id"), F.col("th").alias("held_th"), "gaps", "last")
    # the whole row as one column: its names can't meet those of the helpers
    x = docs.select(F.struct("*").alias("row")).withColumns({"own": F.col("row.doc_id"), "own_th": F.xxhash64(F.coalesce("row.text", F.lit("")))})
    both = x.join(held, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_th") == F.col("held_th")), "left")
    text, found = F.col("row.text"), F.col("gaps").isNotNull()
    piece = lambda g: text.substr((g["a"] + 1).cast("int"), (g["b"] - g["a"]).cast("int"))
    tail = text.substr((F.col("last") + 1).cast("int"), F.length(text))
    masked = F.when(found, F.concat(F.array_join(F.transform("gaps", piece), MASK), F.lit(MASK), tail)).otherwise(text)
    out = both.select("row", found.alias("found"), masked.alias("masked"))
    value = {"text": F.col("masked"), "n_chars": F.when(F.col("found"), F.length("masked")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[value[f.name].cast(f.dataType).alias(f.name) if value.get(f.name) is not None else F.col("row").getField(f.name).alias(f.name) for f in docs.schema])
