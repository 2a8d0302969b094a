"""Secret scan: known forms, and strings that pass for random (operator 4).

The battery looks at runs of token characters outside the known forms. Each gets
an encoding from its characters and three tests against a uniform draw from that
alphabet: chi-squared over equal cells, Wald-Wolfowitz runs about the middle, and
lag-one serial correlation, combined by Fisher's method. Short strings pass such
tests easily, so what counts is how often ordinary text does: the words of
every document, run together, are cut from end to end into decoys of each length
class. A candidate's p-value is the share of decoys of its class that look as
random, and candidates are accepted per length class by Benjamini-Hochberg over the
whole corpus.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from editpulse.llm.common import Scratch, documents, whole

FALSE_SHARE = 0.01
KINDS = ("assign", "access", "hex", "random")


def either_case(letters: str) -> str:
    return "".join(f"[{c.upper()}{c}]" for c in letters)


WORDS = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])
#: Equal to the base patterns: runs are maximal, so a minimum length can stand in the pattern where nothing else is consumed.
ASSIGN_HEAD = f"""(?:{WORDS})["']?\\x20*[:=]\\x20*["']?"""
ASSIGN = re.compile(ASSIGN_HEAD + r"([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: A superset of all matches, for the pass over whole batches.
ANY = f"""(?:{WORDS})["']?\\x20*[:=]|AKIA[A-Z0-9]{{16}}|[0-9a-f]{{24}}|[A-Za-z0-9+/_-]{{20}}"""

#: Least lengths of the length classes.
LENGTHS = np.array([20, 24, 32, 48, 64, 96])
#: Symbols of decoys that are tested at a time.
PIECE = 1 << 19
#: Scores are in bins of a quarter of a power of ten, 0 the most random.
BINS = 64
DIGITS, CAPITALS, SMALL = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {
    "hex": (re.compile(r"(?=.*[0-9])(?=.*[a-f])[0-9a-f]+|(?=.*[0-9])(?=.*[A-F])[0-9A-F]+"), DIGITS + "abcdef"),
    "base32": (re.compile(r"(?=.*[A-Z])(?=.*[2-7])[A-Z2-7]+"), CAPITALS + "234567"),
    "base62": (re.compile(r"(?=.*[a-zA-Z])(?=.*[0-9])[A-Za-z0-9]+|(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+"), CAPITALS + SMALL + DIGITS),
    "base64": (re.compile(r"(?=.*[0-9a-zA-Z])[A-Za-z0-9+/]+"), CAPITALS + SMALL + DIGITS + "+/"),
    "base64url": (re.compile(r"(?=.*[0-9a-zA-Z])[A-Za-z0-9_-]+"), CAPITALS + SMALL + DIGITS + "-_"),
}


def table_of(alphabet: str) -> np.ndarray:
    table = np.zeros(128, np.int64)
    for i, c in enumerate(alphabet):
        table[ord(c)] = i
    return table


TABLES = {name: (table_of(alphabet), len(alphabet)) for name, (_, alphabet) in ALPHABETS.items()}
#: Case doesn't change a hex digit.
TABLES["hex"][0][[ord(c) for c in "ABCDEF"]] = np.arange(10, 16)


def normal_tail(z: np.ndarray) -> np.ndarray:
    """P(Z > z)."""
    z = np.ravel(z) / math.sqrt(2)
    return 0.5 * np.fromiter(map(math.erfc, z.tolist()), np.float64, len(z))


def randomness(symbols: np.ndarray, size: int) -> np.ndarray:
    """Combined p-value of each row of symbols (0..size-1) as uniform draws."""
    rows, n = symbols.shape
    cells = max(2, min(size, n // 3))
    cell_of = np.arange(size) * cells // size
    share = np.bincount(cell_of, minlength=cells) / size
    counts = np.bincount((cell_of[symbols] + cells * np.arange(rows)[:, None]).ravel(), minlength=rows * cells).reshape(rows, cells)
    chi2 = ((counts - n * share) ** 2 / (n * share)).sum(axis=1)
    df = cells - 1
    cube = ((chi2 / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))  # Wilson-Hilferty
    p_chi2 = normal_tail(cube)

    high = symbols >= size / 2
    ups = high.sum(axis=1)
    downs = n - ups
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    expected = 1 + 2 * ups * downs / n
    spread = 2 * ups * downs * np.maximum(2 * ups * downs - n, 0) / (n * n * (n - 1))
    z = np.where(spread > 0, (runs - expected) / np.sqrt(np.where(spread > 0, spread, 1)), 40.0)
    p_runs = 2 * normal_tail(np.abs(z))

    centred = symbols - symbols.mean(axis=1, keepdims=True)
    variance = (centred**2).sum(axis=1)
    lagged = (centred[:, 1:] * centred[:, :-1]).sum(axis=1)
    r = np.where(variance > 0, lagged / np.where(variance > 0, variance, 1), 1.0)
    p_serial = 2 * normal_tail(np.abs(r + 1 / n) * math.sqrt(n))

    logs = -np.log(np.maximum([p_chi2, p_runs, np.minimum(p_serial, 1)], 1e-30)).sum(axis=0)
    return np.exp(-logs) * (1 + logs + logs**2 / 2)  # the tail of chi-squared with six degrees of freedom


def bins_of(p: np.ndarray) -> np.ndarray:
    return np.minimum(BINS - 1, np.floor(-4 * np.log10(np.maximum(p, 1e-30)))).astype(np.int64)


def encoding_of(token: str) -> str | None:
    """The first alphabet that holds the token; None for plain words and numbers."""
    return next((name for name, (form, _) in ALPHABETS.items() if form.fullmatch(token)), None)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, encoding) of the runs that no base span touches."""
    starts = [a for a, _, _ in base]
    furthest = list(accumulate((b for _, _, b in base), max))
    for m in TOKEN.finditer(text):
        before = bisect_left(starts, m.end())  # spans that start before the run ends
        touched = before and furthest[before - 1] > m.start()
        if not touched and (name := encoding_of(m.group())):
            yield m.start(), m.end(), name


def symbols_of(token: str, name: str) -> np.ndarray:
    return TABLES[name][0][np.frombuffer(token.encode(), np.uint8)][None, :]


NOT_TOKEN = re.compile(r"[^A-Za-z0-9+/_-]+")


def decoys(texts: list[str]) -> np.ndarray:
    """Counts (length class, bin): the words of each text, run together, cut from its first to its last into base64 of each length.

    What is left at a text's end, shorter than a decoy, gives none.
    """
    counts = np.zeros((len(LENGTHS), BINS), np.int64)
    table, size = TABLES["base64url"]
    table = table.copy()
    table[[ord("+"), ord("/")]] = 62, 63
    # Runs that are candidates themselves are no ordinary text.
    stretches = [NOT_TOKEN.sub("", TOKEN.sub(" ", t)) for t in texts]
    for k, length in enumerate(LENGTHS.tolist()):
        codes = np.frombuffer("".join(s[: len(s) - len(s) % length] for s in stretches).encode(), np.uint8).reshape(-1, length)
        step = PIECE // length
        for at in range(0, len(codes), step):
            counts[k] += np.bincount(bins_of(randomness(table[codes[at : at + step]], size)), minlength=BINS)
    return counts


FOUND = (
    "doc_id long, base array<struct<start:int,kind:int,stop:int>>, tokens array<struct<start:int,stop:int,length_class:int,bin:int>>, "
    "length_class int, bin int, n long"
)
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
TOKEN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("length_class", pa.int32()), ("bin", pa.int32())]))


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and behind them the task's decoy counts (with doc_id null and ``n``)."""
    counts = np.zeros((len(LENGTHS), BINS), np.int64)
    names = ["doc_id", "base", "tokens", "length_class", "bin", "n"]
    types = [pa.int64(), SPAN_TYPE, TOKEN_TYPE, pa.int32(), pa.int32(), pa.int64()]
    for batch in batches:
        texts = batch.column("text").to_pylist()
        hit = pc.match_substring_regex(batch.column("text"), ANY).to_pylist()
        base = [base_spans(t) if h else [] for t, h in zip(texts, hit)]
        tokens = []
        for text, h, spans in zip(texts, hit, base):
            own = []
            for start, stop, name in candidates(text, spans) if h else ():
                p = randomness(symbols_of(text[start:stop], name), TABLES[name][1])
                own.append((start, stop, int(np.searchsorted(LENGTHS, stop - start, side="right")) - 1, int(bins_of(p)[0])))
            tokens.append([dict(zip(("start", "stop", "length_class", "bin"), x)) for x in own])
        counts += decoys(texts)
        n = len(texts)
        spans = [[dict(zip(("start", "kind", "stop"), x)) for x in s] for s in base]
        values = [batch.column("doc_id"), spans, tokens, *[[None] * n] * 3]
        yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, types)], names)
    k, b = np.nonzero(counts)
    values = [[None] * len(k), [None] * len(k), [None] * len(k), k, b, counts[k, b]]
    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names)


def thresholds(decoy: dict[tuple[int, int], int], candidate: dict[tuple[int, int], int], false_share: float) -> dict[int, int]:
    """Per length class the last bin accepted by Benjamini-Hochberg, -1 for none.

    No p-value is below 1 / (1 + D) with D decoys of the class, so a class with
    1 + D < 1 / ``false_share`` accepts nothing: that few cannot show so small a share.
    """
    accepted = {}
    for k in range(len(LENGTHS)):
        d = np.cumsum([decoy.get((k, b), 0) for b in range(BINS)])
        c = np.cumsum([candidate.get((k, b), 0) for b in range(BINS)])
        if not c[-1]:
            accepted[k] = -1
            continue
        p = (1 + d) / (1 + d[-1])
        fine = np.flatnonzero((c > 0) & (p * c[-1] <= false_share * c))
        accepted[k] = int(fine[-1]) if len(fine) else -1
    return accepted


def find_secrets(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """doc_id and ``spans``, an array of (start, kind, stop) by start and kind, for every row of ``docs``.

    Offsets are code points, ends exclusive; kind is a place in KINDS. Null texts
    are empty and have no spans; null and repeated doc_ids are rows like others.
    Random strings are reported only where all texts together have words for
    1 / ``false_share`` - 1 decoys of the length class (99 decoys of 20 characters, or
    of 96, by default); with less text only the known forms are.
    Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = docs.select("doc_id", whole().alias("text"))
    found = scratch.table(rows.mapInArrow(scan, FOUND), "found")
    counted = found.where("n is not null").groupBy("length_class", "bin").agg(F.sum("n").alias("n"))
    tokens = found.select(F.inline("tokens")).groupBy("length_class", "bin").agg(F.count(F.lit(1)).alias("n"))
    # Both have a row per length class and bin at most.
    limits = thresholds(*({(r["length_class"], r["bin"]): r["n"] for r in t.collect()} for t in (counted, tokens)), false_share)
    at = F.array(*[F.lit(limits[k]) for k in range(len(LENGTHS))])
    added = F.transform(
        F.filter("tokens", lambda t: t["bin"] <= F.get(at, t["length_class"])),
        lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), t["stop"].alias("stop")),
    )
    return found.where("n is null").select("doc_id", F.array_sort(F.concat("base", added)).alias("spans"))


def joined(spans) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"),
    )
