"""Piece encoding, vector codes and the prefix trie against plain models and the library, and on awkward input."""

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from annulus.llm import codebooks, conversations, pieces, queries
from annulus.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(tokenizer_path("piece_bpe_32k.model"))


ODD = ["", " ", "  ", "\n", "a", "<s>", "</s> x", "<0x0A>", "▁", "▁▁a", " ▁ b", "�", "é𝒳ß İ", "à", "x" * 5000, "ab" * 3000, " " * 1000, "\x00a\x00", "\t\ta  b", "日本語テキスト", "🙂🙂", "a  \n  b", "it's 'n' e.g. http://a.b/c?d=1", "word " * 3000]


def odd_texts():
    rng = random.Random(1)
    letters = "ab ▁\n\t.,'é𝒳日本0123<>xXßwrd"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)]


def test_pieces_equal_the_library(model):
    texts = odd_texts()
    theirs = model.library.encode(texts, add_bos=True, add_eos=True)
    assert [model.encode(t) for t in texts] == [array("I", x).tobytes() for x in theirs]
    assert model.checked() and model.units.fresh == {}
    assert [model.decode(array("I", x).tobytes()) for x in theirs] == model.library.decode(theirs)
    plain = model.library.encode(texts)
    assert [model.encode(t, begin=False, end=False) for t in texts] == [array("I", x).tobytes() for x in plain]
    model.units["zzz"] = model.units.fresh["zzz"] = b"\1\0\0\0"
    assert not model.checked()
    del model.units["zzz"]


def test_decoding_of_any_ids(model):
    """Marks inside, bytes that are no text, spaces as bytes, unknown ids."""
    rng = random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, 35, rng.randrange(3, 259), rng.randrange(259, 400), rng.randrange(32000), 29871]) for _ in range(rng.randint(0, 8))]
        assert model.decode(array("I", ids).tobytes()) == model.library.decode(ids)


def agenda(text, places):
    """The best adjacent pair first, the left one of equals, until no pair is a piece."""
    s = list(text)
    while True:
        best = min(((places[a + b], i) for i, (a, b) in enumerate(zip(s, s[1:])) if a + b in places), default=None)
        if best is None:
            return s
        s[best[1] : best[1] + 2] = [s[best[1]] + s[best[1] + 1]]


def test_agenda_by_list_and_by_heap(model):
    rng = random.Random(3)
    for _ in range(400):
        t = "".join(rng.choice("thein anrsto▁") for _ in range(rng.randint(1, 40)))
        want = agenda(t, model.places)
        assert model._by_list(list(t), {}) == model._by_heap(list(t), {}) == model.merge(t) == want
    # equal scores: from the left; a piece that may be merged but not used is taken apart
    small = pieces.Pieces.__new__(pieces.Pieces)
    small.places, small.unused = {"aa": 1.0, "aaa": 1.0, "ab": 0.5, "aab": 3.0}, {"aab"}
    for t in ("aaaa", "aab", "aaaab", "a" * 60 + "b"):
        got = small.merge(t)
        assert "".join(got) == t and "aab" not in got
    small.unused = set()
    for t in ("aaaa", "aab", "aaaab", "aaabaab", "a" * 60 + "b"):
        assert small.merge(t) == agenda(t, small.places) == small._by_heap(list(t), {})


def test_long_text_without_a_cut(model):
    """A hundred thousand letters in one unit: no quadratic agenda, and nothing is remembered of it."""
    t = "tion" * 25_000
    n = len(model.units)
    assert array("I", model.library.encode(t)).tobytes() == model.encode(t, begin=False, end=False)
    assert len(model.units) <= n + 2


def test_round_trip(spark):
    rows = [(i, t, "x") for i, t in enumerate(odd_texts()[:300])] + [(None, None, "y"), (7, "again", "z"), (7, "again", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    path = tokenizer_path("piece_bpe_32k.model")
    library = pieces.Pieces(path).library
    want = Counter()
    for i, t, _ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want[i, array("I", ids).tobytes(), library.decode(ids)] += 1
    for check in ("units", "texts", ""):
        got = pieces.round_trip(docs, path, check=check, step=50).collect()
        assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in got) == want
        assert {r.agrees for r in got} == ({True} if check else {None})
    assert pieces.round_trip(docs.limit(0), path).count() == 0
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert pieces.round_trip(named, path).where("doc_id = 'd7'").count() == 3
    coded = pieces.round_trip(docs, path).select("doc_id", "ids")
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in pieces.decoded(coded, path).collect()) == want
    few = {r.doc_id: r.n for r in coded.where("doc_id in (0, 4, 5)").select("doc_id", pieces.unpacked(F.col("ids")).alias("n")).collect()}
    assert few == {i: library.encode(ODD[i], add_bos=True, add_eos=True) for i in (0, 4, 5)}


def test_op11_by_the_library(spark):
    library = pieces.Pieces(tokenizer_path("piece_bpe_32k.model")).library
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op11_sentencepiece(spark, SF).collect():
        ids = library.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.agrees) == (len(ids), True)
        assert r.ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def codes_model(vectors, parts, entries, rounds, scale=4096):
    """(codes, errors, codebooks) by plain loops over all entries; vectors: (id, components)."""
    v = {n: [int(np.floor(float(np.float32(x)) * scale)) for x in c] for n, (_, c) in enumerate(vectors)}
    width = len(vectors[0][1])
    at = [(width // parts * k + min(k, width % parts), width // parts * (k + 1) + min(k + 1, width % parts)) for k in range(parts)]
    seeds = {}
    for n, (i, _) in enumerate(vectors):
        if i is not None:
            seeds[i] = min(seeds.get(i, v[n]), v[n])
    first = [seeds[i] for i in sorted(seeds)[:entries]]
    books = [[e[a:b] for e in first] for a, b in at]

    def look(n, k):
        a, b = at[k]
        d = [sum((x - y) ** 2 for x, y in zip(v[n][a:b], e)) for e in books[k]]
        return min(range(len(d)), key=lambda j: (d[j], j)), min(d)

    for _ in range(rounds):
        new = []
        for k, (a, b) in enumerate(at):
            mine = [look(n, k)[0] for n in v]
            new.append([[sum(v[n][a + x] for n in v if mine[n] == j) // mine.count(j) for x in range(b - a)] if j in mine else e for j, e in enumerate(books[k])])
        books = new
    found = [[look(n, k) for k in range(parts)] for n in v]
    return [bytes(j for j, _ in f) for f in found], [sum(d for _, d in f) for f in found], books


VECTORS = "vec_id long, embedding array<float>, label int, error string"


@pytest.mark.parametrize("case", ["usual", "ties", "few", "uneven", "large"])
def test_vector_codes(spark, case):
    rng = random.Random(case)
    n, width, parts, entries = {"usual": (300, 16, 8, 16), "ties": (200, 16, 8, 16), "few": (5, 16, 8, 16), "uneven": (60, 11, 4, 3), "large": (40, 8, 2, 4)}[case]
    draw = {"ties": lambda: rng.choice([0.0, 1 / 4096, 2 / 4096]), "large": lambda: rng.choice([1e9, -1e9, 3.0, 0.5])}.get(case, lambda: rng.gauss(0, 0.3))
    rows = [(i, [float(np.float32(draw())) for _ in range(width)], rng.choice([None, 1, 2])) for i in range(3, 3 + n)]
    rows += [rows[0], (4, rows[2][1], 1), (None, rows[1][1], None)]  # a repeated row, a repeated id with another vector, a null id
    bad = [(1, None, 1), (0, [1.0] * (width - 1) + [None], 1), (-1, [float("nan")] * width, 2), (-2, [float("inf")] * width, 2), (9999, [1.0], 1), (9998, [], 1), (9997, [1e30] * width, 1)]
    docs = spark.createDataFrame([(*r, "e") for r in rows + bad], VECTORS).repartition(4)
    coded, books = codebooks.compress(docs, parts=parts, entries=entries)
    want_codes, want_errors, want_books = codes_model([(r[0], r[1]) for r in rows], parts, entries, 6)
    assert books == want_books
    got = Counter((r.vec_id, bytes(r.codes), r.error, r.label) for r in coded.collect())
    assert got == Counter((r[0], c, min(e, 2**63 - 1), r[2]) for r, c, e in zip(rows, want_codes, want_errors))
    sums = Counter()
    for r, e in zip(rows, want_errors):
        sums[r[2]] += e
    got = codebooks.by_label(coded).collect()
    assert len(got) == len(rows) and all(r.label_error == min(sums[r.label], 2**63 - 1) for r in got)
    back = codebooks.decompressed(coded, books).collect()
    at = codebooks.cuts(width, parts)
    for r in back:
        assert np.allclose(r.vector, [x / 4096 for k in range(parts) for x in books[k][r.codes[k]]]) and len(r.vector) == at[-1][1]


def test_no_vectors(spark):
    docs = spark.createDataFrame([(1, None, 1, "e"), (None, [1.0], 1, "e")], VECTORS)
    for table in (docs.limit(0), docs):
        coded, books = codebooks.compress(table)
        assert coded.count() == 0 and codebooks.by_label(coded).count() == 0 and books == [[]] * 8
    assert codebooks.digest([[[1, -2]], [[3]]]) == hashlib.sha256(b"1,-2,3").hexdigest()
    with pytest.raises(ValueError):
        codebooks.compress(docs, entries=257)


def test_nearest_by_trees():
    """Many equal entries and distances: the lowest index, and the distance of all entries tried."""
    rng = np.random.default_rng(0)
    for case in range(200):
        k, d, r = rng.integers(1, 20), rng.integers(1, 9), int(rng.choice([1, 3, 100]))
        e, p = rng.integers(-r, r + 1, (k, d)), rng.integers(-r - 2, r + 3, (40, d))
        if case % 3 == 0:
            e, p = e.astype(object) * 10**15, p.astype(object) * 10**15
        index, best = codebooks.nearest(codebooks.build(e), e, p)
        distance = ((p[:, None, :] - e[None]) ** 2).sum(2)
        assert list(index) == [min(range(k), key=lambda j: (x[j], j)) for x in distance]
        assert [int(x) for x in best] == [int(x[j]) for x, j in zip(distance, index)]


def trie_model(rows, family=20, most=4):
    """Nodes of all rebuilt conversations by definition. rows: (conv_id, turn, role, text) with no ties of turn."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        rebuilt[c] = own.get(c - c % family, [])[:h] + own[c][h:]
    members = {}
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members.setdefault(tuple(rebuilt[c][:d]), []).append(c)
    below = {}
    for p in members:
        if p:
            below.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[q] for q in below[p]) if p in below else 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[q] for q in below.get(p, []))
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if len(rebuilt[c]) == len(p)).encode()).hexdigest()
    return Counter((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(below.get(p, [])), leaves[p], saved[p], ends(p), p[-1] if p else None) for p in members)


TURNS = "conv_id long, turn long, role string, text string, node int, n_convs string"
TEXTS = ["a", "a b", " a\tb\x0bc ", "", None, "é  ü", "x y z", "same same"]


def trie_rows(rng, ids, longest):
    return [(c, t if t else None, rng.choice(["user", "user", "", None]), rng.choice(TEXTS)) for c in ids for t in range(rng.randint(0, longest))]


@pytest.mark.parametrize("case", ["small", "hot", "long", "edges"])
def test_prefix_trie(spark, case, monkeypatch):
    """Families with and without their base, turnless ones, copies of one conversation, long ones, ids below zero and at the ends."""
    rng = random.Random(case)
    if case == "small":
        rows = trie_rows(rng, [i for i in range(-60, 200) if rng.random() < 0.7], 5)
    elif case == "hot":
        same = [(t, "user", f"turn {t} of all") for t in range(3)]
        rows = [(c, *x) for c in range(0, 900) for x in same] + trie_rows(rng, range(900, 1000), 3)
        monkeypatch.setattr(conversations, "BLOCK", 4)
    elif case == "long":
        rows = [(c, t, "user", f"{t % 7} w" if t < 90 or c % 3 else f"{t} {c}") for c in (0, 1, 2, 20, 40, 41) for t in range(150)]
    else:
        top = 2**63 - 1
        rows = trie_rows(rng, [-(2**63), -(2**63) + 1, -(2**63) + 25, -1, 0, 19, 20, top, top - 1, top - 30], 4)
        rows += [(7, 0, "user", "only one"), (None, 1, "user", "nobody's"), (2, 5, None, None)]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], TURNS).repartition(5)
    nodes = conversations.prefix_trie(docs)
    got = conversations.labelled(nodes, docs).collect()
    as_row = lambda r: (r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256, (r.role, r.text) if r.depth else None)
    assert Counter(map(as_row, got)) == trie_model(rows)
    assert all((r.parent is None) == (r.depth == 0) for r in got)


def test_trie_in_small_parts(spark):
    """A family's trie that is given out before it is done is merged to the same nodes; equal turns and repeated rows."""
    import pyarrow as pa

    rng = random.Random(9)
    rows = []
    for kin in range(6):
        for place in range(20):
            rows += [(kin, place, kin * 20 + place, bytes([rng.randrange(3)]) * 16, 2) for _ in range(rng.randint(1, 9))]
    table = pa.RecordBatch.from_pylist([dict(zip(("kin", "place", "conv_id", "turn_key", "words"), r)) for r in rows])
    parts = [table.slice(i, 37) for i in range(0, len(rows), 37)]

    def merged(room):
        out = {}
        for node, up, depth, key, n_words, n, conv, kin, ends in (r for some in conversations.family_tries(iter(parts), 4, room) for r in some):
            held = out.setdefault(node, [tuple(up), depth, key, n_words, 0, conv, {}])
            assert held[:4] == [tuple(up), depth, key, n_words]
            held[4] += n
            held[5] = min(held[5], conv)
            held[6][kin] = held[6].get(kin, 0) | ends
        return out

    assert merged(10) == merged(10**6) and len(merged(10)) > 50
    assert list(conversations.family_tries(iter([]), 4)) == [[]]


def test_trie_of_repeats_and_of_nothing(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "b"), (3, None, "user", "c"), (3, None, "user", "d")]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], TURNS)
    once, twice = (sorted(tuple(r) for r in conversations.prefix_trie(docs.repartition(n)).drop("node", "parent", "turn_key").fillna(-1).collect()) for n in (1, 5))
    assert once == twice and once[0][0] == 0 and once[0][3] == 2
    assert conversations.prefix_trie(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        conversations.prefix_trie(docs, family=64)
    root = conversations.prefix_trie(spark.createDataFrame([(5, 0, "user", "x", 1, "n")], TURNS)).collect()
    assert sum(r.depth == 0 for r in root) == 1


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_prefix_trie"])
def test_queries(spark, name):
    r = queries.queries()[name](spark, SF)
    if name == "op12_vector_codes":
        kept = [(x.vec_id, x.embedding) for x in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
        codes, errors, books = codes_model(kept, 8, 16, 6)
        assert {x.vec_id: (x.code, x.error) for x in r.collect()} == {i: (c.hex(), e) for (i, _), c, e in zip(kept, codes, errors)}
        assert {x.codebooks_sha256 for x in r.collect()} == {codebooks.digest(books)}
    else:
        rows = [tuple(x) for x in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert Counter(tuple(x) for x in r.collect()) == Counter(k[:-1] for k in trie_model(rows).elements())
