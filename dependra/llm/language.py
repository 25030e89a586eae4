"""Language identification by unigram pieces whose segmentation is summed out.

The pieces are a fixed public vocabulary. For each language a probability of every piece is learned by expectation
maximisation over all segmentations of words. A word's likelihood in a language is the sum over all its segmentations,
by the forward algorithm; a text's is the product over its words, as no piece crosses a word's end.

Words are runs of letters, lower-cased, whole and of the whole text, however long; a score of a long word takes no more memory than its
letters. Words of more than 2,000 letters are learned from in parts of so many, each as a word of its own. Defined cases: null texts and texts without a
letter get `und` and the score 0; without a learned language every text does. Characters outside the vocabulary share one probability. Ties go to the first
language in code-point order. Rows with null lang or null doc_id teach nothing, rows with one doc_id once (by the smallest text). Other columns pass through.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dependra.llm.common import sampled, table, with_python

LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"
#: Letters of a word that is learned from in one piece.
LEARNED = 2_000
PRIME = np.uint64(0x100000001B3)


def vocabulary(path: str | None = None) -> list[str]:
    """The usable pieces of a public sentencepiece model: letters only, lower case, with or without a word's start."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return sorted({p for p in pieces if LETTERS.fullmatch(p.removeprefix(START)) and p == p.lower()} | {START})


def _hash(points: np.ndarray) -> np.ndarray:
    h = np.full(points.shape[:-1], 7, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(points.shape[-1]):
            h = h * PRIME + points[..., i]
    return h


class PieceModel:
    """p[piece, language]; the row after the last piece is any other character, the one after it impossible."""

    def __init__(self, pieces: list[str], langs: list[str]):
        self.langs, self.longest, n = langs, max(map(len, pieces)), len(pieces)
        h = np.array([int(_hash(np.array([[ord(c) for c in p]], np.uint64))[0]) for p in pieces], np.uint64)
        self.order = np.argsort(h).astype(np.int32)
        self.hashes, self.n = h[self.order], n
        self.p = np.full((n + 2, len(langs)), 1 / (n + 1))
        self.p[n + 1] = 0

    def _ids(self, points: np.ndarray) -> list[np.ndarray]:
        """For each length, the piece at every place of equally long words."""
        out, width, h = [], points.shape[1], None
        with np.errstate(over="ignore"):
            for size in range(1, min(self.longest, width) + 1):
                h = (np.uint64(7) * PRIME + points) if size == 1 else h[:, :-1] * PRIME + points[:, size - 1 :]
                at = np.minimum(np.searchsorted(self.hashes, h), self.n - 1)
                out.append(np.where(self.hashes[at] == h, self.order[at], self.n if size == 1 else self.n + 1))
        return out

    def _forward(self, points: np.ndarray, chunk: int = 4_096):
        """The logarithms of the sums over all segmentations of equally long words, by language.

        Only the places that a next piece can start from are held, and the pieces of `chunk` places, whatever a word's length.
        """
        k, width = points.shape
        held = [np.ones((k, self.p.shape[1]))]  # the last places, on one scale
        scale = np.zeros(k)
        for begin in range(0, width, chunk):
            low = max(0, begin - self.longest + 1)
            ids = self._ids(points[:, low : min(width, begin + chunk)])
            for j in range(begin + 1, min(width, begin + chunk) + 1):
                now = np.zeros_like(held[0])
                for size in range(1, min(self.longest, j) + 1):
                    now += held[-size] * self.p[ids[size - 1][:, j - size - low]]
                top = now.max(axis=1)
                scale += np.log(top)
                held = [x / top[:, None] for x in (*held[-self.longest + 1 :], now)] if self.longest > 1 else [now / top[:, None]]
        return np.log(np.maximum(held[-1], 1e-300)) + scale[:, None]

    def log_likelihoods(self, words: list[str], most: int = 20_000) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)))
        for index, points in self._by_length(words, most):
            out[index] = self._forward(points)
        return out

    def _by_length(self, words: list[str], most: int):
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for group in np.split(order, cuts) if len(order) else []:
            width = int(lengths[group[0]])
            for i in range(0, len(group), step := max(1, most * 12 // (width + 1))):
                part = group[i : i + step]
                text = "".join(START + words[w] for w in part)
                yield part, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), width + 1).astype(np.uint64)

    def learn(self, words: list[str], counts: np.ndarray, rounds: int = 4, smooth: float = 0.02) -> None:
        """counts[word, language]; each round takes the expected uses of each piece over all segmentations."""
        for _ in range(rounds):
            used = np.zeros_like(self.p)
            for index, points in self._by_length(words, 5_000):
                k, width = points.shape
                ids = self._ids(points)
                # Sums over what stands before and behind each place; the true ones are these times e to the power la, lb.
                a = np.zeros((width + 1, k, len(self.langs)))
                b = np.zeros_like(a)
                a[0] = b[width] = 1
                la, lb = np.zeros(a.shape), np.zeros(a.shape)
                for j in range(1, width + 1):
                    i = width - j
                    la[j], lb[i] = la[j - 1], lb[i + 1]
                    for size in range(1, min(self.longest, j) + 1):
                        a[j] += a[j - size] * self.p[ids[size - 1][:, j - size]] * np.exp(la[j - size] - la[j])
                        b[i] += b[i + size] * self.p[ids[size - 1][:, i]] * np.exp(lb[i + size] - lb[i])
                    for x, lx, at in ((a, la, j), (b, lb, i)):
                        top = np.maximum(x[at], 1e-300)
                        lx[at] += np.log(top)
                        x[at] /= top
                total = counts[index]
                for size in range(1, len(ids) + 1):
                    for i in range(width - size + 1):
                        found = ids[size - 1][:, i]
                        at = np.flatnonzero(found <= self.n)
                        if len(at):
                            e = a[i][at] * self.p[found[at]] * b[i + size][at] * np.exp((la[i] + lb[i + size] - la[width])[at]) * total[at] / a[width][at]
                            for lang in range(len(self.langs)):
                                used[:, lang] += np.bincount(found[at], e[:, lang], self.n + 2)
            used[: self.n + 1] += smooth
            used[self.n + 1] = 0
            self.p = used / used.sum(axis=0)


class Identifier:
    """Scores texts; remembers the likelihoods of words up to a bound."""

    LIMIT = 300_000

    def __init__(self, model: PieceModel):
        self.model, self.known = model, {}
        self.table = np.zeros((0, len(model.langs)))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        found = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        if not self.model.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        if len(self.known) > self.LIMIT:
            self.known, self.table = {}, self.table[:0]
        new = sorted({w for ws in found for w in ws if w not in self.known})
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.table = np.concatenate([self.table, self.model.log_likelihoods(new)])
        langs, scores = [], np.zeros(len(texts))
        for i, ws in enumerate(found):
            if not any(c.isalpha() for w in ws for c in w):  # ends at the first letter
                langs.append("und")
                continue
            s = self.table[np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
            best = int(s.argmax())
            langs.append(self.model.langs[best])
            scores[i] = 1 / np.exp(np.maximum(s - s[best], -700)).sum()
        return langs, scores


def fit_languages(docs: DataFrame, per_lang: int = 250, vocabulary_path: str | None = None, seed: int = 5) -> PieceModel:
    """Learns from text and lang of docs, from about per_lang documents of each language (a bound that is a parameter)."""
    some = sampled(docs.where("lang is not null and doc_id is not null").select("doc_id", "lang", "text"), "lang", per_lang, "doc_id", seed)
    # Rows with one doc_id, however many, are one text of the sample.
    some = some.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def count(batches):
        import pyarrow as pa
        from collections import Counter

        seen = Counter()
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                seen.update((lang, w[i : i + LEARNED]) for w in LETTERS.findall((text or "").lower()) for i in range(0, len(w), LEARNED))
        rows = sorted(seen.items())
        yield pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in rows], pa.string()), pa.array([r[0][1] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["lang", "word", "n"])

    rows = some.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect()
    langs, words = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    at_lang, at_word = {x: i for i, x in enumerate(langs)}, {x: i for i, x in enumerate(words)}
    counts = np.zeros((len(words), len(langs)))
    for lang, word, n in rows:
        counts[at_word[word], at_lang[lang]] = n
    model = PieceModel(vocabulary(vocabulary_path), langs)
    if langs:
        model.learn(words, counts)
    return model


def identify_language(docs: DataFrame, model: PieceModel, keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred and score, the posterior of the language under equal priors."""

    def make():
        identify = Identifier(model)
        return lambda batch: list(identify(batch.column("text").to_pylist()))

    return with_python(docs, make, "lang_pred string, score double", keep)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs.where("pmod(crc32(cast(doc_id as string)), 3) <> 1"))
    return identify_language(docs.select("doc_id", "text"), model, ["doc_id"]).selectExpr("doc_id", "coalesce(pmod(crc32(cast(doc_id as string)), 3) = 1, true) held_out", "lang_pred", "score")
