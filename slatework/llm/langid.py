"""Language identification by segmentation-marginalised unigrams (operator 1).

The vocabulary is that of a public tokenizer, read from its file and fixed:
its pieces of letters, lower-cased, with the word-start mark. For each
language every piece has a probability; a word's likelihood is the sum over
all its segmentations into pieces, by the forward algorithm, and a text's is
the product over its words (runs of letters, lower case).

The probabilities are learned by expectation maximisation on a bounded sample
of labelled documents (``per_lang`` a language): the forward-backward
algorithm gives the expected piece counts over all segmentations. The E-step
runs over the sample's word table in Spark; what comes back is one number per
piece and language.

Scoring needs no shuffle: each task scores the distinct words of a batch
together (vectorised over words) and remembers them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import seeded, slices, stored, table, unit

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
RUN = 32  # longer runs of letters are scored one by one; the model learns from them in stretches of this many
LONGEST = 64  # characters of a piece with its start mark; the vocabulary has no longer one
PER_LANG = 400
LANGS = 500  # languages learned at most: those with most distinct texts
TURNS = 3
FLOOR = 1e-7  # probability of a character that begins no piece
START = "▁"
MEMO = 300_000
UNDETERMINED = "und"

_LETTERS = re.compile(r"[^\W\d_]+")


def read_pieces(path: str = VOCABULARY, longest: int = LONGEST) -> list[str]:
    """The vocabulary's pieces of letters in lower case, each once, sorted."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in found if len(p) <= longest and p.replace(START, "", 1).isalpha())


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters with the start mark."""
    return [START + w for w in _LETTERS.findall(text.lower())] if text else []


def stretches(words: list[str]) -> list[str]:
    """Words to learn from: those of over ``RUN`` letters in stretches."""
    return [w if len(w) <= RUN + 1 else START + w[i:i + RUN] for w in words
            for i in range(1, 2 if len(w) <= RUN + 1 else len(w), RUN)]


class Pieces:
    """The vocabulary as hash tables, for looking up many substrings at once."""

    BITS = 18

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        h = np.array([self._hash(np.array([[ord(c) for c in p]], np.uint64))[0, 0, len(p)] for p in pieces], np.uint64)
        self.tables = []
        left = np.arange(self.n)
        while len(left):
            slot = self._slot(h[left], len(self.tables))
            _, first = np.unique(slot, return_index=True)
            ids = np.zeros(1 << self.BITS, np.int32)
            keys = np.zeros(1 << self.BITS, np.uint64)
            ids[slot[first]], keys[slot[first]] = left[first] + 1, h[left[first]]
            self.tables.append((keys, ids))
            left = np.delete(left, first)

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        """codes (n, L) -> (n, L, longest + 1) would be large; see ``hashes``."""
        n, size = codes.shape
        out = np.zeros((n, 1, size + 1), np.uint64)
        for j in range(size):
            out[:, 0, j + 1] = Pieces._push(out[:, 0, j], codes[:, j])
        return out

    @staticmethod
    def _push(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        h = (h ^ code) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    def _slot(self, h: np.ndarray, turn: int) -> np.ndarray:
        return (h * np.uint64(0xBF58476D1CE4E5B9 + 2 * turn) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def along(self, codes: np.ndarray) -> np.ndarray:
        """One word's codes (L,) -> (longest, L): number of the piece of l + 1 characters at each place."""
        out = np.zeros((self.longest, len(codes)), np.int32)
        h = np.zeros(len(codes), np.uint64)
        for size in range(1, min(self.longest, len(codes)) + 1):
            h = self._push(h[:len(codes) - size + 1], codes[size - 1:])
            for t, (keys, ids) in enumerate(self.tables):
                slot = self._slot(h, t)
                out[size - 1, :len(h)] = np.where(keys[slot] == h, ids[slot], out[size - 1, :len(h)])
        return out

    def find(self, codes: np.ndarray) -> list[list[np.ndarray]]:
        """codes (L, n) -> at[i][l - 1]: number (0: none) of the piece that begins
        at place i and has l characters, for each of the n words."""
        size = len(codes)
        at = []
        for i in range(size):
            h = np.zeros(codes.shape[1], np.uint64)
            row = []
            for j in range(i, min(size, i + self.longest)):
                h = self._push(h, codes[j])
                got = np.zeros(len(h), np.int32)
                for t, (keys, ids) in enumerate(self.tables):
                    slot = self._slot(h, t)
                    got = np.where(keys[slot] == h, ids[slot], got)
                row.append(got)
            at.append(row)
        return at


def _coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points (L, n) padded with 0, and lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", errors="surrogatepass"), np.uint32)
    codes = np.zeros((int(sizes.max(initial=0)), len(words)), np.uint64)
    place = np.concatenate([np.arange(s) for s in sizes]) if len(words) else np.empty(0, np.int64)
    codes[place, np.repeat(np.arange(len(words)), sizes)] = flat
    return codes, sizes


def _floor(at: list[list[np.ndarray]], i: int) -> np.ndarray:
    """FLOOR where the single character at i is no piece."""
    return np.where(at[i][0] == 0, FLOOR, 0.0)[:, None]


def forward(pieces: Pieces, probs: np.ndarray, words: list[str]) -> np.ndarray:
    """log P(word | language), (n words, languages): sums over all segmentations.

    ``probs``: (pieces + 1, languages), row 0 zero."""
    out = np.empty((len(words), probs.shape[1]))
    sizes = np.array([len(w) for w in words], np.int64)
    for i in np.flatnonzero(sizes > RUN + 1):
        out[i] = _long(pieces, probs, words[i])
    order = np.flatnonzero(sizes <= RUN + 1)
    order = order[np.argsort(sizes[order], kind="stable")]
    for lo in range(0, len(order), 4096):  # words of like length together
        some = order[lo:lo + 4096]
        codes, sizes = _coded([words[i] for i in some])
        out[some] = np.log(_alphas(pieces.find(codes), probs, len(some))[sizes, np.arange(len(some))])
    return out


def _long(pieces: Pieces, probs: np.ndarray, word: str) -> np.ndarray:
    """``forward`` for one word of any length: only the last ``longest`` places are
    held, each scaled to 1, and the scales' logarithms are summed."""
    codes = np.frombuffer(word.encode("utf-32-le", errors="surrogatepass"), np.uint32).astype(np.uint64)
    log, ahead = np.zeros(probs.shape[1]), np.zeros((pieces.longest + 1, probs.shape[1]))
    for lo in range(0, len(codes), 1 << 16):
        n = min(1 << 16, len(codes) - lo)
        at = pieces.along(codes[lo:lo + n + pieces.longest - 1])[:, :n]
        place, size = np.nonzero(at.T)
        cuts = np.searchsorted(place, np.arange(n + 1))
        for i in range(n):
            some = size[cuts[i]:cuts[i + 1]]
            ahead[some + 1] += probs[at[some, i]]
            if not at[0, i]:
                ahead[1] += FLOOR
            scale = ahead[1].copy()
            log += np.log(scale)
            ahead[:-1] = ahead[1:] / scale
            ahead[-1] = 0
            ahead[0] = 1
    return log


def _alphas(at: list[list[np.ndarray]], probs: np.ndarray, n: int) -> np.ndarray:
    """(L + 1, n, languages) probabilities of the first j characters."""
    alpha = np.zeros((len(at) + 1, n, probs.shape[1]))
    alpha[0] = 1.0
    for i, row in enumerate(at):
        for size, got in enumerate(row, 1):
            alpha[i + size] += alpha[i] * probs[got]
        alpha[i + 1] += alpha[i] * _floor(at, i)
    return alpha


def expected(pieces: Pieces, probs: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected piece counts (pieces + 1, languages) of words with counts (n, languages)."""
    total = np.zeros_like(probs)
    order = np.argsort([len(w) for w in words], kind="stable")
    for lo in range(0, len(words), 4096):
        some = order[lo:lo + 4096]
        n = len(some)
        codes, sizes = _coded([words[i] for i in some])
        at = pieces.find(codes)
        alpha = _alphas(at, probs, n)
        beta = np.zeros_like(alpha)
        beta[sizes, np.arange(n)] = counts[some] / alpha[sizes, np.arange(n)]
        for i in reversed(range(len(at))):
            for size, got in enumerate(at[i], 1):
                part = probs[got] * beta[i + size]
                beta[i] += part
                share = alpha[i] * part
                for k in range(probs.shape[1]):
                    total[:, k] += np.bincount(got, share[:, k], len(total))
            beta[i] += _floor(at, i) * beta[i + 1]
    total[0] = 0
    return total


@dataclass
class Model:
    """Languages (sorted), pieces and (pieces + 1, languages) probabilities."""

    langs: list[str]
    pieces: Pieces
    probs: np.ndarray


def sample(docs: DataFrame, per_lang: int, lang_col: str, text_col: str) -> DataFrame:
    """(``_lang``, ``_text``): at most ``per_lang`` distinct texts a language, chosen by a
    hash of the text; thinned by rate first, so no language meets in one task.

    Copies share their hash, so both the rate and the sample count distinct
    texts; a language of fewer than ``2 * per_lang`` is not thinned. Of more than
    ``LANGS`` languages those with most distinct texts are learned."""
    x = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    counts = x.select("_lang", F.xxhash64("_text").alias("_x")).distinct().groupBy("_lang").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.orderBy(F.desc("_n"), "_lang").limit(LANGS)  # a dirty column may hold any number of values
    x = x.withColumn("_h", seeded(1, F.xxhash64("_text")))
    # at most LANGS rows; else the texts would be shuffled by language
    x = x.join(F.broadcast(counts), "_lang").filter(unit(F.col("_h")) < F.lit(2.0 * per_lang) / F.col("_n"))
    x = x.select("_lang", "_h", "_text").distinct()  # copies meet in each task before they are shuffled
    place = F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "_text"))
    return x.withColumn("_place", place).filter(F.col("_place") <= per_lang).select("_lang", "_text")


def fit(docs: DataFrame, path: str = VOCABULARY, per_lang: int = PER_LANG, turns: int = TURNS, lang_col: str = "lang",
        text_col: str = "text") -> Model:
    """Learn from the rows with a language; null languages and texts are left out."""
    spark = docs.sparkSession
    rows = sample(docs, per_lang, lang_col, text_col)

    def count(batches):
        from collections import Counter
        for b in slices(batches):
            got = Counter((lang, w) for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                          for w in stretches(words_of(text)))
            yield pa.RecordBatch.from_pydict({"lang": [k for k, _ in got], "word": [w for _, w in got], "n": list(got.values())},
                                             pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))

    words = rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stored(words, "sample-words")
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())  # as many as languages
    pieces = Pieces(read_pieces(path))
    probs = np.full((pieces.n + 1, len(langs)), 1.0 / max(1, pieces.n))
    probs[0] = 0
    for _ in range(turns if langs else 0):
        state = spark.sparkContext.broadcast((pieces, probs, langs))

        def count_pieces(batches, state=state):
            pieces, probs, langs = state.value
            place = {x: i for i, x in enumerate(langs)}
            total = np.zeros_like(probs)
            for b in slices(batches):
                counts = np.zeros((b.num_rows, len(langs)))
                at = [place[x] for x in b.column(0).to_pylist()]
                counts[np.arange(b.num_rows), at] = b.column(2).to_numpy()
                total += expected(pieces, probs, b.column(1).to_pylist(), counts)
            p, k = np.nonzero(total)
            yield pa.RecordBatch.from_pydict({"p": p.astype(np.int32), "k": k.astype(np.int32), "e": total[p, k]})

        got = words.mapInArrow(count_pieces, "p int, k int, e double").groupBy("p", "k").agg(F.sum("e").alias("e"))
        found = got.toPandas()  # at most pieces x languages
        new = np.full_like(probs, 0.01)
        new[found["p"], found["k"]] += found["e"]
        new[0] = 0
        probs = new / new.sum(axis=0)
        state.destroy()
    return Model(langs, pieces, probs)


def predict(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text") -> DataFrame:
    """``carry``, ``lang_pred`` and ``score`` (the language's posterior, all languages
    being equally likely before). A null text, one without letters, or a model
    without languages gives ``und`` and score 0; of equal scores the first
    language by name wins. Texts are scored whole."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    x = docs.select(*carry, F.col(text_col).alias("_text"))

    def run(batches):
        m = shared.value
        memo: dict[str, int] = {}
        known = np.empty((0, len(m.langs)))
        for b in slices(batches):
            if len(memo) > MEMO:
                memo, known = {}, known[:0]
            texts = [words_of(t) for t in b.column("_text").to_pylist()]
            new = list(set().union(*texts).difference(memo))
            if new and m.langs:
                known = np.concatenate([known, forward(m.pieces, m.probs, new)])
                memo.update(zip(new, range(len(memo), len(memo) + len(new)), strict=True))
            langs, scores = [], []
            for words in texts:
                if not m.langs or not any(c.isalpha() for w in words for c in w):
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                total = known[[memo[w] for w in words]].sum(axis=0)
                best = int(total.argmax())
                langs.append(m.langs[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*carry, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType
    fields = [x.schema[c] for c in carry]
    return x.mapInArrow(run, StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 1 over whole ``documents``; rows with held_out (or a null id) are not learned from."""
    docs = table(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = fit(docs.filter(part != 0))
    held = docs.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "text")
    return predict(held, model, ["doc_id", "held_out"])
