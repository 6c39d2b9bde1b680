"""Language identification of words by a linear-chain conditional random field.

States are the languages of the labelled rows.  A word's emission score sums
learned weights of its character n-grams with word boundaries (those that touch
a boundary are its affixes) and of its entry in a lexicon of words seen often in
training.  Transition weights are learned together with them from sequences
spliced of pieces in several languages, so the chain holds to a language where a
single word is unsure, and yet switches.  Forward-backward gives each word's
posterior; a text's language is the one with the largest mean posterior.

Training reads at most ``rows`` labelled rows per language and a bounded number
of words of each; prediction reads every word of every text.  Texts that are
null or have no letter are ``und`` with score 0.  Equal texts get equal results.
Ties between languages go to the first in order of name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import materialised

WORD = re.compile(r"[^\W\d_]+")
UNDEFINED = "und"
#: Hashed n-gram features, and the longest n-gram.
BITS, LONGEST = 16, 4
#: Words of a text that one training piece takes, and pieces per text.
PIECE, PIECES = 24, 3
#: Words that a chunk of the parallel forward-backward holds, and words per pass.
CHUNK, PASS = 32, 300_000
#: Words whose emissions a task remembers.
REMEMBERED = 200_000
#: Languages whose row counts may be broadcast.
BROADCAST_LANGUAGES = 100_000


def words_of(text: str | None) -> list[str]:
    """Runs of letters; other numerals than digits, which the pattern lets pass, part words as digits do."""
    found = WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return ["".join(run) for word in found for letters, run in groupby(word, str.isalpha) if letters]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram features that start at each character, start of each word, hash of each whole word).

    A feature that would cross the end of its word is the unused one, ``1 << BITS``.
    """
    joined = "".join(f"^{w}$" for w in words)
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(chars)) - np.repeat(starts, lengths)
    left = np.repeat(lengths, lengths) - place
    whole = np.add.reduceat(_mixed(chars + place.astype(np.uint64) * np.uint64(0x100000001)), starts)
    grams = np.full((LONGEST, len(chars)), 1 << BITS, np.int64)
    rolling = np.zeros(len(chars), np.uint64)
    for n in range(1, LONGEST + 1):
        rolling = rolling[: len(chars) - n + 1] * np.uint64(0x100000001B3) + chars[n - 1 :] + np.uint64(1)
        hashed = (_mixed(rolling + np.uint64(n)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
        grams[n - 1, : len(rolling)] = np.where(left[: len(rolling)] >= n, hashed, 1 << BITS)
    return grams, starts, whole


def _sums(values: np.ndarray, index: np.ndarray, size: int) -> np.ndarray:
    """Column sums of ``values`` by ``index``."""
    return np.stack([np.bincount(index, values[:, k], size) for k in range(values.shape[1])], 1)


class _Numbers(dict):
    """Words by order of first sight."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray
    lexicon: np.ndarray
    lexicon_weights: np.ndarray
    transitions: np.ndarray
    _known: dict = field(default_factory=dict, repr=False)

    def emissions(self, words: list[str]) -> np.ndarray:
        grams, starts, whole = features(words)
        by_char = self.grams[grams[0]]
        for row in grams[1:]:
            by_char += self.grams[row]
        out = np.add.reduceat(by_char, starts, axis=0)
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, whole), len(self.lexicon) - 1)
            out += np.where((self.lexicon[at] == whole)[:, None], self.lexicon_weights[at], 0)
        return out

    def scores(self, words: list[str]) -> np.ndarray:
        """Emissions of a long list of words, each distinct word worked out once."""
        known: _Numbers = self._known.setdefault("ids", _Numbers())
        if len(known) > REMEMBERED:
            self._known.clear()
            known = self._known.setdefault("ids", _Numbers())
        old = len(known)
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if len(known) > old:
            new = self.emissions(list(islice(known, old, None))).astype(np.float32)
            self._known["table"] = np.concatenate([self._known["table"], new]) if old else new
        return self._known["table"][at]

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_known": {}}


def posteriors(scores: np.ndarray, transitions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Word posteriors of several chains laid end to end, by forward-backward.

    Chains are cut in chunks of ``CHUNK`` words.  Each chunk's transfer matrix
    comes from all chunks in step; messages then pass from chunk to chunk, and
    enter the chunks, which again go in step.
    """
    n, k = scores.shape
    psi = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float64)
    step = np.exp(transitions - transitions.max())
    per = -(-lengths // CHUNK)
    chain = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(len(chain)) - (np.cumsum(per) - per)[chain]
    size = np.minimum(CHUNK, lengths[chain] - nth * CHUNK)
    # full chunks first: those that reach a step are then a slice
    order = np.argsort(-size, kind="stable")
    where = np.empty_like(order)
    where[order] = np.arange(len(order))
    begin = ((np.cumsum(lengths) - lengths)[chain] + nth * CHUNK)[order]
    size, opening = size[order], (nth == 0)[order]
    reach = np.searchsorted(-size, -np.arange(CHUNK), side="left")
    at = np.minimum(begin[:, None] + np.arange(CHUNK), n - 1)
    local = psi[at.T]

    # row i of a transfer matrix: the chunk's forward message if state i came before it
    transfer = np.broadcast_to(np.eye(k), (len(chain), k, k)).copy()
    for t in range(CHUNK):
        m = reach[t]
        came = (transfer[:m].reshape(-1, k) @ step).reshape(m, k, k)
        if t == 0:  # nothing comes before a chain's first word
            came[opening] = 1.0
        new = came * local[t, :m, None, :]
        if t % 8 == 7:
            new /= new.max((1, 2), keepdims=True)
        transfer[:m] = new
    transfer /= transfer.max((1, 2), keepdims=True)
    before, after = np.full((len(chain), k), 1.0 / k), np.full((len(chain), k), 1.0 / k)
    ranked = np.argsort(-per, kind="stable")
    longest = int(per.max())
    alive = np.searchsorted(-per[ranked], -np.arange(longest), side="left")
    first = np.cumsum(per) - per
    for c in range(1, longest):
        ids = first[ranked[: alive[c]]] + c
        v = np.einsum("ci,cij->cj", before[where[ids - 1]], transfer[where[ids - 1]])
        before[where[ids]] = v / v.sum(1, keepdims=True)
    for c in range(1, longest):
        ids = (first + per)[ranked[: alive[c]]] - 1 - c
        v = np.einsum("cij,cj->ci", transfer[where[ids + 1]], after[where[ids + 1]])
        after[where[ids]] = v / v.sum(1, keepdims=True)

    post = np.empty((CHUNK, len(chain), k))
    message = before
    for t in range(CHUNK):
        m = reach[t]
        came = message[:m] @ step if t else np.where(opening[:m, None], 1.0, message[:m] @ step)
        message = came * local[t, :m]
        message /= message.sum(1, keepdims=True)
        post[t, :m] = message
    message = after
    for t in range(CHUNK - 1, -1, -1):
        m = reach[t]
        post[t, :m] *= message[:m]
        new = (message[:m] * local[t, :m]) @ step.T
        message[:m] = new / new.sum(1, keepdims=True)
    out = np.empty((n, k))
    for t in range(CHUNK):
        out[begin[: reach[t]] + t] = post[t, : reach[t]]
    return out / out.sum(1, keepdims=True)


def fit(pieces: dict[str, list[list[str]]], steps: int = 100, batch: int = 256, length: int = 32, seed: int = 5) -> Model:
    """A CRF from word lists by language: conditional likelihood by Adagrad on spliced sequences."""
    languages = sorted(pieces)
    k = len(languages)
    rng = np.random.default_rng(seed)
    known: dict[str, int] = {}
    runs = [[[known.setdefault(w, len(known)) for w in p] for p in pieces[lang] if p] for lang in languages]
    words = list(known)
    grams, starts, whole = features(words)
    counts = np.bincount(np.concatenate([np.asarray(r) for lang in runs for r in lang]), minlength=len(words))
    lexicon = np.unique(whole[counts >= 3])
    entry = np.minimum(np.searchsorted(lexicon, whole), max(len(lexicon) - 1, 0))
    known_word = lexicon[entry] == whole if len(lexicon) else np.zeros(len(words), bool)
    ends = np.append(starts[1:], grams.shape[1])
    weights = {"g": np.zeros(((1 << BITS) + 1, k)), "l": np.zeros((max(len(lexicon), 1), k)), "t": np.zeros((k, k))}
    squares = {name: np.full(w.shape, 1e-8) for name, w in weights.items()}
    for _ in range(steps):
        ids, gold = np.empty((batch, length), np.int64), np.empty((batch, length), np.int64)
        for b in range(batch):
            filled = 0
            while filled < length:
                lang = int(rng.integers(k))
                run = runs[lang][int(rng.integers(len(runs[lang])))]
                take = run[: min(int(rng.integers(2, PIECE + 1)), length - filled)]
                ids[b, filled : filled + len(take)], gold[b, filled : filled + len(take)] = take, lang
                filled += len(take)
        used, flat = np.unique(ids.ravel(), return_inverse=True)
        labels = gold.ravel()
        width = ends[used] - starts[used]
        firsts = np.cumsum(width) - width
        own = grams[:, np.repeat(starts[used] - firsts, width) + np.arange(int(width.sum()))]
        lex = np.flatnonzero(known_word[used])
        emit = np.add.reduceat(weights["g"][own].sum(0), firsts, axis=0)
        emit[lex] += weights["l"][entry[used[lex]]]
        post, pair = _pairwise(emit[flat].reshape(batch, length, k), weights["t"])
        error = post.reshape(-1, k)
        error[np.arange(len(labels)), labels] -= 1
        by_word = _sums(error, flat, len(used))
        seen = np.zeros((k, k))
        np.add.at(seen, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        spread = np.tile(np.repeat(by_word, width, axis=0), (LONGEST, 1))
        slopes = {"g": _sums(spread, own.ravel(), (1 << BITS) + 1), "l": _sums(by_word[lex], entry[used[lex]], len(weights["l"])), "t": pair - seen}
        slopes["g"][-1] = 0
        for name, slope in slopes.items():
            slope = slope / batch + 1e-5 * weights[name]
            squares[name] += slope**2
            weights[name] -= 0.3 * slope / np.sqrt(squares[name])
    return Model(languages, weights["g"].astype(np.float32), lexicon, weights["l"].astype(np.float32), weights["t"])


def _pairwise(scores: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of equally long chains, and expected counts of transitions."""
    b, n, k = scores.shape
    psi, step = np.exp(scores - scores.max(2, keepdims=True)), np.exp(transitions - transitions.max())
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    alpha[:, 0] = psi[:, 0]
    for t in range(1, n):
        alpha[:, t - 1] /= alpha[:, t - 1].sum(1, keepdims=True)
        alpha[:, t] = (alpha[:, t - 1] @ step) * psi[:, t]
    for t in range(n - 2, -1, -1):
        beta[:, t] = (beta[:, t + 1] * psi[:, t + 1]) @ step.T
        beta[:, t] /= beta[:, t].sum(1, keepdims=True)
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    pairs = alpha[:, :-1, :, None] * step * (psi[:, 1:] * beta[:, 1:])[:, :, None, :]
    pairs /= pairs.sum((2, 3), keepdims=True)
    return post, pairs.sum((0, 1))


def held_out() -> Column:
    """Rows no model may learn from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, rows: int = 400, steps: int = 100) -> Model | None:
    """Fit on at most ``rows`` labelled rows per language, chosen by hash; None if there are none."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    hashed = labelled.withColumn("h", F.xxhash64(F.lit(3), F.col("doc_id"), F.col("text")))
    draw = F.pmod("h", F.lit(1 << 30))
    # a language of any size sends about four times the rows it needs to the task that ranks them
    sizes = materialised(hashed.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    # a few rows, so that no language's rows meet in one task before they are thinned
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_LANGUAGES else sizes
    thin = hashed.select("lang", "h", draw.alias("draw")).join(sizes, "lang").where(F.col("draw").cast("double") * F.col("n") < 4.0 * rows * (1 << 30))
    order = Window.partitionBy("lang").orderBy("draw", "h")
    chosen = thin.select("lang", "h", "draw").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows).select("lang", "h")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                words = words_of(text)
                for i in range(PIECES):
                    if piece := words[len(words) * i // PIECES :][:PIECE]:
                        out.append((lang, piece))
            yield pd.DataFrame(out, columns=["lang", "words"])

    # at most rows per language, so the chosen side is small by parameter
    sample = hashed.join(F.broadcast(chosen), ["lang", "h"], "left_semi").select("lang", "text")
    pieces: dict[str, list[list[str]]] = {}
    for r in sample.mapInPandas(cut, "lang string, words array<string>").collect():
        pieces.setdefault(r.lang, []).append(list(r.words))
    for found in pieces.values():
        found.sort()
    return fit(pieces, steps) if pieces else None


def _passes(texts: pd.Series) -> Iterator[tuple[list[int], list[str], np.ndarray]]:
    """Rows with words, their words laid end to end, and how many each has, in passes of bounded size."""
    rows, words, lengths = [], [], []
    for i, text in enumerate(texts):
        if found := words_of(text):
            rows.append(i)
            words += found
            lengths.append(len(found))
        if len(words) >= PASS:
            yield rows, words, np.asarray(lengths)
            rows, words, lengths = [], [], []
    if rows:
        yield rows, words, np.asarray(lengths)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from ``text`` alone; columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "__lid")]

    @F.pandas_udf("lang_pred string, score double")
    def of_text(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, best = np.full(len(texts), UNDEFINED, object), np.zeros(len(texts))
            for rows, words, lengths in _passes(texts) if model else ():
                post = posteriors(model.scores(words), model.transitions, lengths)
                mean = np.add.reduceat(post, np.cumsum(lengths) - lengths, axis=0) / lengths[:, None]
                names[rows] = np.asarray(model.languages, object)[mean.argmax(1)]
                best[rows] = np.minimum(mean.max(1), 1.0)
            yield pd.DataFrame({"lang_pred": names, "score": best})

    return docs.withColumn("__lid", of_text("text")).select(*kept, "__lid.lang_pred", "__lid.score")


def label_words(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``word_langs``: every word of the text, in order, and its language."""

    @F.pandas_udf("array<struct<word:string,lang:string>>")
    def of_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list[list[dict]] = [[] for _ in range(len(texts))]
            for rows, words, lengths in _passes(texts) if model else ():
                labels = posteriors(model.scores(words), model.transitions, lengths).argmax(1)
                ends = np.cumsum(lengths)
                for row, a, b in zip(rows, ends - lengths, ends, strict=True):
                    out[row] = [{"word": w, "lang": model.languages[i]} for w, i in zip(words[a:b], labels[a:b], strict=True)]
            yield pd.Series(out)

    return docs.withColumn("word_langs", of_text("text"))


def report(docs: DataFrame, rows: int = 400) -> DataFrame:
    """The language of every text, by a model that never saw the held-out rows."""
    model = train(docs, rows)
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
