"""Fingerprints, the Merkle manifest and whitening against plain versions, on rows of all kinds and on empty tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from editpulse.llm import fingerprint, merkle, registry, whitening

# ------------------------------------------------------------ 11


def phrases(text):
    """The phrase set, by slicing."""
    data, known, start = text.encode(), set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in known:
            known.add(data[start:end])
            start = end
    return known


def jaccard(a, b):
    x, y = phrases(a), phrases(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def expected_fingerprints(rows):
    """Plain rows (doc_id, text), with distinct ids, in the contract's order."""
    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    out = []
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        new = edited(text, following)
        prints = [fingerprint.fingerprint(t) for t in (text, new, following)]
        out.append((
            i, len(text), hashlib.sha256(new.encode()).hexdigest(), prints[0].hex(), prints[1].hex(),
            fingerprint.likeness(prints[0], prints[1]), fingerprint.likeness(prints[0], prints[2]),
        ))
    return out


def test_parser_finds_the_phrases(raw):
    for text in {r[1] for r in raw if r[1]}:
        parser = fingerprint.Parser()
        parser.feed(text.encode())
        assert len(parser.hashes) - 1 == len(phrases(text)) == len(set(parser.hashes[1:]))


def test_parser_goes_back():
    for cut in range(0, 30, 3):
        text = "abababcabcabcddababab éèabab"
        parser = fingerprint.Parser()
        parser.feed(text[:cut].encode())
        mark = parser.mark()
        parser.feed(b"something else, then abababab")
        parser.go_back(mark)
        parser.feed(text[cut:].encode())
        assert parser.fingerprint() == fingerprint.fingerprint(text)


def test_likeness_estimates_that_of_the_phrases(raw):
    texts = sorted({r[1] for r in raw if r[1] and len(r[1]) > 100})
    off = []
    for a, b in zip(texts, texts[1:]):
        for x, y in ((a, b), (a, edited(a, b))):
            off.append(fingerprint.likeness(fingerprint.fingerprint(x), fingerprint.fingerprint(y)) - jaccard(x, y))
    assert np.abs(off).max() < 0.15 and abs(np.mean(off)) < 0.03
    assert fingerprint.likeness(fingerprint.fingerprint(""), fingerprint.fingerprint("")) == 1
    assert fingerprint.likeness(fingerprint.fingerprint(""), fingerprint.fingerprint("a")) == 0


@pytest.mark.parametrize("parts", [1, 3, 200])
def test_fingerprints(spark, raw, parts):
    """Whatever the number of range partitions, one row in each included."""
    distinct = {i: t for i, t, *_ in raw if i is not None}
    docs = spark.createDataFrame([(i, t, "x") for i, t in distinct.items()], "doc_id long, text string, part string").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = [tuple(r) for r in fingerprint.fingerprints(docs).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(found) == sorted(expected_fingerprints(distinct.items()))


def test_fingerprints_of_repeated_rows_and_nulls(docs, raw):
    found = fingerprint.fingerprints(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.fingerprint) for r in found) == Counter(
        (i, len(t or ""), fingerprint.fingerprint(t or "").hex()) for i, t, *_ in raw
    )
    assert [f.dataType.simpleString() for f in fingerprint.fingerprints(docs).schema.fields][:3] == ["bigint", "bigint", "string"]
    again = fingerprint.fingerprints(docs.repartition(2)).collect()
    assert Counter(tuple(r) for r in found) == Counter(tuple(r) for r in again)


def test_fingerprints_of_few(spark, empty):
    assert fingerprint.fingerprints(empty).count() == 0
    one = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    assert [tuple(r) for r in fingerprint.fingerprints(one).collect()] == expected_fingerprints([(5, "abcdef")])


# ------------------------------------------------------------ 12


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = [row[0], row[3], row[2], row[4], text]
    return sha(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def proof_tree(nodes):
    """The root, and per node its steps of what stands left and right."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i - i % 3 : i - i % 3 + 3]
            paths[k].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        nodes = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], paths


def expected_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars, ...)."""
    low = lambda x, least: (x is not None, least if x is None else x)
    sources = defaultdict(list)
    for row in rows:
        sources[row[3]].append((low(row[0], 0), leaf(row, row[1]), row))
    names = sorted(sources, key=lambda s: low(s and s.encode(), b""))
    trees = []
    for name in names:
        members = sorted(sources[name], key=lambda m: m[:2])
        trees.append((members, *proof_tree([m[1] for m in members])))
    root, above = proof_tree([t[1] for t in trees])
    out = []
    for (members, subroot, paths), upper in zip(trees, above):
        for (_, own, row), path in zip(members, paths):
            steps, node = path + upper, own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[1] is not None:
                node = leaf(row, row[1].replace("\n", ""))
            for left, right in steps:
                node = sha(left, node, right)
            out.append((row[0], own, subroot, root, sha(*[a + b for a, b in steps]), node, node == root))
    return Counter(out)


@pytest.mark.parametrize("height", [0, 1, 2, 6])
def test_manifest(docs, raw, height):
    """The same tree whatever the size of a block, so with rounds between blocks and without."""
    assert Counter(tuple(r) for r in merkle.manifest(docs, height).collect()) == expected_manifest(raw)


@pytest.mark.parametrize("sizes", [[1], [2], [27], [28], [3, 1, 10, 82], [1] * 11])
def test_manifest_of_sources_of_all_sizes(spark, sizes):
    rows = [(i * 100 + k, f"text\n{k % 5}", None, f"é{i}", k) for i, n in enumerate(sizes) for k in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    found = merkle.manifest(frame, 1).collect()
    assert Counter(tuple(r) for r in found) == expected_manifest(rows)
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 2 == 1) for r in found)


def test_manifest_of_nothing(empty):
    assert merkle.manifest(empty).count() == 0


# ------------------------------------------------------------ 13


def vectors_of_all_kinds(n=300, dim=40, seed=3):
    draw = np.random.default_rng(seed)
    scales = np.geomspace(8, 0.2, dim)
    rows = [(i, [float(np.float32(c)) for c in draw.normal(0, 1, dim) * scales + 3], i % 3) for i in range(n)]
    rows += [rows[0], rows[0], (None, rows[1][1], None)]
    bad = [float("nan")] + [0.0] * (dim - 1)
    return rows, [(9001, None, 1), (9002, bad, 1), (9003, [float("-inf")] * dim, 1), (9004, [None] + [1.0] * (dim - 1), 1), (9005, [], 1)]


def brute_force(rows):
    x = np.floor(64 * np.array([v for _, v, _ in rows])).astype(object).astype(int) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    white = centred @ vectors[:, ::-1] / np.sqrt(values[::-1])
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return white, values[::-1] / values.sum(), deviation


SCHEMA = "vec_id long, embedding array<float>, label int, n string"


@pytest.mark.parametrize("dim", [1, 5, 40])
def test_whitening(spark, dim):
    rows, bad = vectors_of_all_kinds(dim=dim)
    frame = spark.createDataFrame([(*r, "clash") for r in rows + bad], SCHEMA).repartition(5)
    found = whitening.whiten(frame).collect()
    white, explained, deviation = brute_force(rows)
    k = min(dim, 32)
    assert Counter((r.vec_id, r.component) for r in found) == Counter((i, c + 1) for i, _, _ in rows for c in range(k))
    place = {r[0]: at for at, r in enumerate(rows)}
    signs = {}
    for r in found:
        at, c = place[r.vec_id], r.component - 1
        assert r.n == len(rows) and r.deviation == deviation[at]
        assert abs(r.explained / explained[c] - 1) < 1e-9 and r.identity_error < 1e-9
        sign = signs.setdefault(c, np.sign(r.whitened * white[at, c]))
        assert r.whitened == pytest.approx(sign * white[at, c], abs=1e-7)


def test_whitening_keeps_small_eigenvalues(spark):
    """Whole numbers far from zero, one direction a hundred million times longer than another."""
    draw = np.random.default_rng(1)
    wide = draw.integers(-(2**26), 2**26, 200)
    rows = [(i, [float(w), float(w + draw.integers(0, 3)), float(draw.integers(0, 2))], 0) for i, w in enumerate(wide)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    fits = whitening.fitted(frame.select("vec_id", "embedding"))
    x = np.floor(64 * np.array([v for _, v, _ in rows])) + 1_000_000
    singular = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    assert np.allclose(fits[3].explained, singular**2 / (singular**2).sum(), rtol=1e-6, atol=0)
    assert fits[3].identity_error < 1e-6


def test_whitening_of_too_few_vectors(spark):
    """Only directions with variance are components; one of a length has none."""
    rows, _ = vectors_of_all_kinds(6, 12)
    rows = [(i, v, 0) for i, (_, v, _) in enumerate(rows[:6])] + [(50, [1.0, 2.0], 0), (51, [2.0], 0), (52, [5.0], 0)]
    found = whitening.whiten(spark.createDataFrame([(*r, "") for r in rows], SCHEMA)).collect()
    assert Counter(r.vec_id for r in found) == {0: 5, 1: 5, 2: 5, 3: 5, 4: 5, 5: 5, 51: 1, 52: 1}
    assert all(r.identity_error < 1e-6 for r in found)
    assert sorted(r.whitened for r in found if r.vec_id > 50) == pytest.approx([-1, 1])
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deviation_beyond_a_long(spark):
    rows = [(1, [1e17, 0.0], 0, ""), (2, [-1e17, 1.0], 0, ""), (3, [1e30, 1.0], 0, "")]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert found and {r.deviation for r in found} == {None}


def test_new_queries(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = registry.QUERIES["op11_phrase_fingerprints"](spark, sf)
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected_fingerprints([(r.doc_id, r.text) for r in docs.collect()]))
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    white, explained, deviation = brute_force(rows)
    table = registry.QUERIES["op13_whitened_embeddings"](spark, sf).toPandas().sort_values(["vec_id", "component"])
    order = np.argsort([r[0] for r in rows])
    mine = table.whitened.to_numpy().reshape(len(rows), 32)
    assert np.abs(np.abs(mine) - np.abs(white[order, :32])).max() < 1e-7
    assert np.allclose(table.explained[:32], explained[:32], rtol=1e-9)
    assert (table.deviation.to_numpy()[::32] == np.array(deviation)[order]).all() and (table.n == len(rows)).all()
