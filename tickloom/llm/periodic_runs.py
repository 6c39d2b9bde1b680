"""Runs of periodically repeated words, by block convolution.

A run is a maximal stretch of words with smallest period q and at least
``max(6, 4 q)`` words.  At the scale B, a power of two with B <= q < 2 B, such a
run holds an aligned block of B words that recurs q words later.  The sum of
squared differences between a block and every placement in the window behind it
is one correlation, taken by a number-theoretic transform, so it is an exact
integer; where it is zero, block and placement agree.  The distances found seed
runs: neighbouring blocks that recur at one distance form a chain, and only the
two ends of a chain are extended word by word.

Words are small integer codes during the transform, small enough that no sum
reaches the modulus.  Different words may share a code: that can only add a
placement, and placements are compared word by word before they count.
"""

from __future__ import annotations

from collections import defaultdict
from functools import cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The modulus 7 * 2**20 + 1 and its primitive root: products of 64 residues add up exactly in doubles.
PRIME, ROOT = 7340033, 3
#: Transforms up to this length are one matrix product, longer ones are built of them.
DIRECT = 64
#: The longest block; larger periods are searched with several windows behind each block.
MAX_BLOCK = 1 << 19
#: Elements of a batch of blocks.
BATCH = 1 << 20
#: The shortest run, and the least number of periods in it.
MIN_LENGTH, MIN_PERIODS = 6, 4

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _residues(x: np.ndarray) -> np.ndarray:
    """``x`` less multiples of the modulus; -1 and the modulus itself may remain."""
    return x - np.floor(x * (1.0 / PRIME)) * PRIME


@cache
def _matrix(n: int, inverse: bool) -> np.ndarray:
    w = pow(ROOT, (PRIME - 1) // n, PRIME)
    w = pow(w, -1, PRIME) if inverse else w
    powers = [1]
    for _ in range(n - 1):
        powers.append(powers[-1] * w % PRIME)
    return np.array(powers, dtype=np.float64)[np.outer(np.arange(n), np.arange(n)) % n]


@cache
def _twiddles(n: int, inverse: bool) -> np.ndarray:
    w = pow(ROOT, (PRIME - 1) // n, PRIME)
    w = pow(w, -1, PRIME) if inverse else w
    powers = [1]
    for _ in range(n - 1):
        powers.append(powers[-1] * w % PRIME)
    return np.array(powers, dtype=np.float64)[np.outer(np.arange(DIRECT), np.arange(n // DIRECT))]


def transform(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The transform of each row of ``x`` (integers in doubles, a power of two wide), not scaled."""
    rows, n = x.shape
    if n <= DIRECT:
        return _residues(x @ _matrix(n, inverse))
    cut = np.matmul(_matrix(DIRECT, inverse), x.reshape(rows, DIRECT, n // DIRECT))
    cut = _residues(_residues(cut) * _twiddles(n, inverse))
    cut = transform(cut.reshape(rows * DIRECT, n // DIRECT), inverse)
    return cut.reshape(rows, DIRECT, n // DIRECT).transpose(0, 2, 1).reshape(rows, n)


def placements(codes: np.ndarray, squares: np.ndarray, starts: np.ndarray, block: int, low: int) -> np.ndarray:
    """Whether the block at each start recurs at the distances ``low`` to ``low + block - 1``, a row per start.

    ``squares`` are prefix sums of squared codes; both reach ``low + 2 * block`` beyond the last start.
    """
    n = 2 * block
    blocks = np.zeros((len(starts), n))
    blocks[:, :block] = codes[starts[:, None] + np.arange(block)]
    windows = codes[starts[:, None] + (low + np.arange(n))].astype(np.float64)
    product = _residues(transform(windows) * transform(blocks, inverse=True))
    sums = _residues(transform(product, inverse=True)[:, :block] * pow(n, -1, PRIME))
    sums = np.where(sums < 0, sums + PRIME, np.where(sums >= PRIME, sums - PRIME, sums)).astype(np.int64)
    later = starts[:, None] + (low + np.arange(block))
    energy = (squares[starts + block] - squares[starts])[:, None] + squares[later + block] - squares[later]
    return energy == 2 * sums


def _scales(longest: int, max_block: int):
    """Blocks and least distances that cover all periods of a text of ``longest`` words."""
    block = low = 1
    while max(MIN_LENGTH, MIN_PERIODS * low) <= longest:
        yield block, low
        low += block
        block = min(low, max_block)


def _stretch(words: np.ndarray, at: int, q: int, step: int) -> int:
    """How many words in a row from ``at`` on, forward or backward, equal the word ``q`` later."""
    size, n, total = 16, len(words), 0
    while True:
        if step > 0:
            to = min(at + size, n - q)
            same = words[at:to] == words[at + q : to + q] if to > at else np.zeros(0, bool)
        else:
            to = max(at - size + 1, 0)
            same = (words[to : at + 1] == words[to + q : at + 1 + q])[::-1] if at >= 0 else np.zeros(0, bool)
        if not same.all() or len(same) < size:
            return total + (int(np.argmin(same)) if not same.all() else len(same))
        total, at, size = total + size, at + step * size, size * 2


def runs_of(words: np.ndarray, ends: np.ndarray, max_block: int = MAX_BLOCK) -> list[tuple[int, int, int]]:
    """``(start, end, period)`` of all runs, ends exclusive, by start and period.

    ``words`` are the word numbers of texts one after another, each text followed by a negative
    number of its own; ``ends`` are the places of those numbers.
    """
    firsts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
    lengths = ends - firsts
    total = len(words)
    found: set[tuple[int, int, int]] = set()
    whole: set[tuple[int, int]] = set()
    # the longest known run at each place
    cover = np.zeros((3, total), dtype=np.int64)
    for block, low in _scales(int(lengths.max(initial=0)), max_block):
        long = np.flatnonzero(lengths >= max(MIN_LENGTH, MIN_PERIODS * low))
        # aligned blocks with room for a recurrence in their text
        at = -(-firsts[long] // block)
        count = np.maximum((ends[long] - low - block) // block - at + 1, 0)
        owner = np.repeat(long, count)
        starts = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at, count)) * block
        span = int(np.sqrt((PRIME - 1) // block))
        codes = np.concatenate([(words * 2654435761 >> 7) % span, np.zeros(low + 2 * block + 1, np.int64)])
        squares = np.concatenate([[0], np.cumsum(codes * codes)])
        step = max(1, BATCH // (2 * block))
        seeds = []
        for k in range(0, len(starts), step):
            some = starts[k : k + step]
            row, d = np.nonzero(placements(codes, squares, some, block, low))
            i, q, own = some[row], d + low, owner[k : k + step][row]
            inside = (i + q + block <= ends[own]) & (MIN_PERIODS * q <= lengths[own])
            i, q = i[inside], q[inside]
            # a multiple of the period of a known run around block and placement finds the same stretch again
            known = cover[2, i]
            fresh = ~((known > 0) & (q % np.maximum(known, 1) == 0) & (cover[0, i] <= i) & (i + q + block <= cover[1, i]))
            i, q = i[fresh], q[fresh]
            for part in range(0, len(i), step):
                a, b = i[part : part + step], q[part : part + step]
                same = (words[a[:, None] + np.arange(block)] == words[(a + b)[:, None] + np.arange(block)]).all(axis=1)
                seeds.append(np.stack([b[same], a[same]]))
        if not seeds:
            continue
        q, i = np.concatenate(seeds, axis=1)
        order = np.lexsort((i, q))
        q, i = q[order], i[order]
        heads = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (i[1:] - i[:-1] != block)])) if len(q) else np.zeros(0, int)
        chain = np.diff(np.concatenate([heads, [len(q)]]))
        period = q[heads]
        least = np.maximum(MIN_LENGTH, MIN_PERIODS * period) - period
        enough = (chain + 2) * block - 2 >= least
        for h, c, p in zip(i[heads][enough].tolist(), chain[enough].tolist(), period[enough].tolist(), strict=True):
            start = h - _stretch(words, h - 1, p, -1)
            stop = h + c * block
            stop += _stretch(words, stop, p, 1) + p
            if stop - start >= max(MIN_LENGTH, MIN_PERIODS * p) and (start, stop) not in whole:
                whole.add((start, stop))
                found.add((start, stop, p))
                mine = cover[:, start:stop]
                mine[:, mine[1] - mine[0] < stop - start] = np.array([[start], [stop], [p]])
    return sorted(found, key=lambda r: (r[0], r[2]))


def _texts(texts: list[str | None], max_block: int) -> tuple[list, list]:
    """Runs and collapsed text of each text of a batch."""
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    words = np.empty(sum(map(len, split)) + len(split), dtype=np.int64)
    ends, at = np.empty(len(split), dtype=np.int64), 0
    for k, one in enumerate(split):
        words[at : at + len(one)] = [numbers[w] for w in one]
        at += len(one)
        words[at] = -1 - k
        ends[k] = at
        at += 1
    runs: list[list] = [[] for _ in split]
    dropped: dict[int, np.ndarray] = {}
    for (start, stop, q), k in zip(
        found := runs_of(words, ends, max_block), np.searchsorted(ends, [r[0] for r in found]).tolist(), strict=True
    ):
        first = int(ends[k]) - len(split[k])
        runs[k].append({"start": start - first, "length": stop - start, "period": q})
        kept = dropped.setdefault(k, np.ones(len(split[k]), bool))
        kept[start - first + q : stop - first] = False
    collapsed = [b" ".join(compress(s, dropped[k].tolist()) if k in dropped else s).decode("utf-8", "surrogatepass") for k, s in enumerate(split)]
    return runs, collapsed


def _batches(texts: list[str | None], words: int = 100_000):
    """Consecutive slices of about so many words; a long text is alone in its slice."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "") // 6 + 1
        if size >= words:
            yield texts[at : k + 1]
            at, size = k + 1, 0
    if at < len(texts):
        yield texts[at:]


def _scanner(max_block: int):
    @F.arrow_udf(f"struct<runs:{RUNS},collapsed:string>")
    def scan(texts: pa.Array) -> pa.Array:
        runs, collapsed = [], []
        for some in _batches(texts.to_pylist()):
            r, c = _texts(some, max_block)
            runs += r
            collapsed += c
        kinds = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        return pa.StructArray.from_arrays([pa.array(runs, pa.list_(kinds)), pa.array(collapsed, pa.string())], names=["runs", "collapsed"])

    return scan


def find_runs(docs: DataFrame, text: str = "text", max_block: int = MAX_BLOCK) -> DataFrame:
    """``docs`` with ``runs`` (start word, length, period; by start, then period) and ``collapsed``.

    Words are split at ASCII white space.  ``collapsed`` joins the words by one blank, without those
    that stand in a run behind its first period.  A text without words, and a null text, has no run
    and the empty ``collapsed``.  Every row is judged alone: repeated rows and ties give repeated
    results, an empty table an empty one.  Input columns named ``runs`` or ``collapsed`` are replaced,
    all others stay.  A text is read whole, whatever its length.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("runs", "collapsed")]
    scanned = docs.select(*others, _scanner(max_block)(F.col(f"`{text}`")).alias("__runs"))
    return scanned.select(*others, "__runs.runs", "__runs.collapsed")


def words_of(text: Column) -> Column:
    """Words of a text between ASCII white space; none of null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_loops(docs: DataFrame) -> DataFrame:
    """``docs`` where every text whose id's checksum is divisible by ten ends in a loop of its own words.

    With h the checksum, g = h // 10 and n words, words from a = g % n on repeat the first
    1 + (n - a) // (3 + g % 8) of them.  Texts without words stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    planted = docs.withColumns({"__h": h, "__w": F.when(F.pmod(h, F.lit(10)) == 0, words_of(F.col("text")))})
    planted = planted.withColumns({"__g": F.expr("__h div 10"), "__n": F.size("__w").cast("long")})
    planted = planted.withColumn("__a", F.when(F.col("__n") > 0, F.pmod("__g", "__n")))
    planted = planted.withColumn("__p", F.expr("1 + (__n - __a) div (3 + __g % 8)"))
    looped = F.expr("array_join(transform(__w, (w, i) -> if(i < __a, w, get(__w, cast(__a + (i - __a) % __p as int)))), ' ')")
    return planted.withColumn("text", F.when(F.col("__n") > 0, looped).otherwise(F.col("text"))).drop("__h", "__w", "__g", "__n", "__a", "__p")


def report(docs: DataFrame) -> DataFrame:
    """Digest of the runs of each document after ``with_loops``."""
    found = find_runs(with_loops(docs.select("doc_id", "text")))
    # exponents compare as cross products of integers
    best = F.expr(
        "array_sort(runs, (a, b) -> case when a.length * b.period <> b.length * a.period "
        "then cast(sign(b.length * a.period - a.length * b.period) as int) "
        "when a.start <> b.start then cast(sign(a.start - b.start) as int) else cast(sign(a.period - b.period) as int) end)"
    )
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    top = found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.get(best, F.lit(0)).alias("top"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    return top.select(
        "doc_id",
        "n_runs",
        "top.start",
        "top.length",
        "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
