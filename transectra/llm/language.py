"""Language ID by unigram pieces, summed over all segmentations.

For each language every piece of a fixed public vocabulary has a probability. The
probability of a word is the sum, over all ways to cut it into pieces, of the product
of theirs (forward algorithm); words are independent, and so are stretches of
``STRETCH`` characters of longer ones. Probabilities are fitted by
expectation-maximisation: a forward and a backward pass give the expected number of
uses of each piece over all cuts of the training words.

Training reads a documented, hash-chosen sample of labelled texts (about
``TRAIN_DOCS`` per language); word counts and expected uses are added up by Spark, and
only piece-by-language tables, bounded by the vocabulary, reach the driver. Prediction
reads every whole text; words met before are looked up, so a text costs one sum.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or if
nothing could be learned. Null and repeated ids stay rows of their own, an empty table
gives an empty result, other columns are ignored. Equal scores: the first language by
name.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import settle
from .tokens import public_path

#: Labelled texts for training per language, on average; the choice is by hash.
TRAIN_DOCS = 1_500
ROUNDS = 3
STRETCH = 31
#: Smoothing count of every piece, and the least probability of any.
ADDED, FLOOR = 0.01, 1e-9
#: Words a worker remembers.
REMEMBERED = 200_000


class Pieces:
    """The vocabulary as a table of strings; the last number but one is an unknown character, the last is no piece."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [library.id_to_piece(i) for i in range(library.get_piece_size())
                 if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))]
        self.number = {p: i for i, p in enumerate(names)}
        self.longest = max(map(len, names))
        self.unknown, self.none = len(names), len(names) + 1

    @cached_property
    def tree(self) -> tuple[np.ndarray, ...]:
        """The vocabulary as a tree in two arrays, so that a step of many walks is two look-ups.

        Gives the code of every character (0: in no piece), for every node where its children
        are and its piece, and for every place its parent and the child there. The root is node
        0; the last node is nowhere, it has no child and no piece.
        """
        children: list[dict[str, int]] = [{}]
        piece = [self.none]
        for name, number in self.number.items():
            at = 0
            for c in name:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    piece.append(self.none)
                at = children[at][c]
            piece[at] = number
        seen = Counter(c for below in children for c in below)
        number = {c: i for i, (c, _) in enumerate(seen.most_common(), 1)}
        code = np.zeros(0x110000, np.int64)
        code[[ord(c) for c in number]] = list(number.values())
        nowhere = len(children)
        places = 4 * nowhere
        base, at = np.zeros(nowhere + 1, np.int64), 0
        parent, child = [-1] * (places + len(number) + 1), [nowhere] * (places + len(number) + 1)
        # Most children first; most places stay free, so few are tried.
        for node in sorted(range(nowhere), key=lambda x: -len(children[x])):
            below = {number[c]: x for c, x in children[node].items()}
            while any(parent[at + c] >= 0 for c in below):
                at = (at + 7919) % places
            base[node] = at
            for c, x in below.items():
                parent[at + c], child[at + c] = node, x
        return code, base, np.asarray([*piece, self.none], np.int32), np.asarray(parent), np.asarray(child)

    def lattice(self, words: list[str]) -> np.ndarray:
        """Piece numbers of words of one length: [word, start, piece length - 1], up to the longest piece met."""
        n, m = len(words), len(words[0])
        code, base, piece, parent, child = self.tree
        # Place by place, so that what lies at one place of all words is together; after the last place nothing goes on.
        text = np.zeros((m + 1, n), np.int64)
        text[:m] = code[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, m).T]
        text = text.reshape(-1)
        start, node, layers = np.arange(m * n), np.zeros(m * n, np.int64), []
        for size in range(min(self.longest, m)):
            to = base[node] + text[start + size * n]
            goes = np.flatnonzero(parent[to] == node)
            if size and not len(goes):
                break
            start, node = start[goes], child[to[goes]]
            layer = np.full(m * n, self.none, np.int32)
            layer[start] = piece[node]
            layers.append(layer)
        single = layers[0]
        single[single == self.none] = self.unknown
        return np.stack(layers).reshape(len(layers), m, n).T


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def stretches(word: str) -> list[str]:
    """A word with its space mark, in stretches."""
    marked = "▁" + word
    return [marked[i:i + STRETCH] for i in range(0, len(marked), STRETCH)]


def forward(grid: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sums of products up to every place: [place, word, language]; ``table`` has a row per piece, the last of zeros."""
    n, m, width = grid.shape
    out = np.zeros((m + 1, n, table.shape[1]))
    out[0] = 1
    for j in range(1, m + 1):
        for size in range(1, min(width, j) + 1):
            out[j] += out[j - size] * table[grid[:, j - size, size - 1]]
    return out


def expected_uses(grid: np.ndarray, table: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece in words met ``weight`` times, for one language."""
    n, m, width = grid.shape
    before = forward(grid, table[:, None])[:, :, 0]
    after = np.zeros((m + 1, n))
    after[m] = 1
    for i in range(m - 1, -1, -1):
        for size in range(1, min(width, m - i) + 1):
            after[i] += table[grid[:, i, size - 1]] * after[i + size]
    scale = weight / before[m]
    out = np.zeros(len(table))
    for i in range(m):
        for size in range(1, min(width, m - i) + 1):
            piece = grid[:, i, size - 1]
            out += np.bincount(piece, before[i] * table[piece] * after[i + size] * scale, len(table))
    return out


def _by_length(words: list[str]) -> dict[int, list[int]]:
    groups = defaultdict(list)
    for i, w in enumerate(words):
        groups[len(w)].append(i)
    return groups


class Scorer:
    """Log probabilities of words in all languages, remembered."""

    def __init__(self, path: str, table: np.ndarray, prior: np.ndarray):
        self.pieces, self.table, self.prior = _pieces(path), table, prior
        self.most = max(10_000, min(REMEMBERED, 8_000_000 // len(prior)))
        self.rows = np.zeros((self.most, len(prior)))
        self.number: dict[str, int] = {}

    def _learn(self, words: list[str]) -> None:
        parts, owner = ["▁" + w for w in words], range(len(words))
        if max(map(len, parts)) > STRETCH:
            cut = [stretches(w) for w in words]
            parts, owner = list(chain.from_iterable(cut)), np.repeat(owner, list(map(len, cut)))
        logs = np.zeros((len(words), len(self.prior)))
        owner = np.asarray(owner, np.int64)
        for group in _by_length(parts).values():
            for a in range(0, len(group), 4096):
                some = group[a:a + 4096]
                last = forward(self.pieces.lattice([parts[i] for i in some]), self.table)[-1]
                np.add.at(logs, owner[some], np.log(last))
        start = len(self.number)
        self.rows[start:start + len(words)] = logs
        self.number.update((w, start + i) for i, w in enumerate(words))

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        """Log of prior and words for lists of words."""
        out = np.empty((len(texts), len(self.prior)))
        # New words of all these texts together, if they fit: text by text, arrays would be small and many.
        met = set(chain.from_iterable(texts))
        if len(met) <= self.most:
            self._meet(met)
        for i, words in enumerate(texts):
            total = self.prior.copy()
            # A text with more words than are remembered is taken in parts.
            for a in range(0, len(words), self.most // 2):
                part = words[a:a + self.most // 2]
                if len(met) > self.most:
                    self._meet(set(part))
                total += self.rows[np.fromiter(map(self.number.__getitem__, part), np.int64, len(part))].sum(axis=0)
            out[i] = total
        return out

    def _meet(self, words: set[str]) -> None:
        new = words.difference(self.number)
        if len(self.number) + len(new) > self.most:
            self.number.clear()
            new = words
        if new:
            self._learn(list(new))


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts within a batch; Spark adds them up."""
    for batch in batches:
        counts: dict[tuple[str, str], int] = defaultdict(int)
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            for w in text.split():
                for s in stretches(w):
                    counts[lang, s] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()),
             pa.array(counts.values(), pa.int64())], names=["lang", "word", "n"])


class Model:
    """Languages, their prior and their piece probabilities."""

    def __init__(self, path: str, langs: list[str], docs: np.ndarray, table: np.ndarray):
        self.path, self.langs, self.table = path, langs, table
        self.prior = np.log((docs + 1) / (docs.sum() + len(docs))) if len(docs) else np.zeros(0)
        self.key = uuid.uuid4().hex


def fit(
    docs: DataFrame, vocabulary: str | None = None, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> Model:
    """Learn from labelled rows that are not held out. Runs jobs."""
    path = vocabulary or public_path("piece_bpe_32k.model")
    labelled = docs.filter(~F.coalesce(held_out(id_col), F.lit(False)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = labelled.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # One row per language: bounded by the number of languages.
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    pieces = _pieces(path)
    shape = (pieces.none + 1, len(langs))
    if not langs:
        return Model(path, [], np.zeros(0), np.zeros(shape))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, train_docs / sizes[k]))])
    # By id and text, so that rows without an id are not drawn all or none.
    chosen = labelled.filter(F.pmod(F.xxhash64("id", "text", F.lit("language")), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    words = settle(chosen.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long")
                   .groupBy("lang", "word").agg(F.sum("n").alias("n"))
                   # Few bytes, much work on each: dealt out, or the rounds would run in a task or two.
                   .repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word"))
    column = {k: i for i, k in enumerate(langs)}
    table = np.full(shape, 1.0 / pieces.none)
    table[pieces.none] = 0
    for _ in range(rounds):
        uses = np.zeros(shape)
        found = words.mapInArrow(_expectation(path, column, table), "lang int, piece int, uses double")
        # At most one row per language and piece.
        for lang, piece, n in found.groupBy("lang", "piece").agg(F.sum("uses")).collect():
            uses[piece, lang] = n
        uses[:-1] += ADDED
        table = np.maximum(uses / uses[:-1].sum(axis=0), FLOOR)
        table[pieces.none] = 0
    return Model(path, langs, np.asarray([sizes[k] for k in langs], float), table)


def _expectation(path: str, column: dict[str, int], table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        uses = np.zeros((len(column), len(table)))
        for batch in batches:
            words, n = batch["word"].to_pylist(), batch["n"].to_numpy(zero_copy_only=False)
            lang = np.asarray([column[k] for k in batch["lang"].to_pylist()], np.int64)
            for group in _by_length(words).values():
                for a in range(0, len(group), 4096):
                    some = np.asarray(group[a:a + 4096])
                    grid = pieces.lattice([words[i] for i in some])
                    for k in np.unique(lang[some]):
                        rows = np.flatnonzero(lang[some] == k)
                        uses[k] += expected_uses(grid[rows], table[:, k], n[some[rows]])
        lang, piece = np.nonzero(uses)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.int32()), pa.array(piece, pa.int32()), pa.array(uses[lang, piece])], names=["lang", "piece", "uses"])

    return run


_last: dict[str, Scorer] = {}


def _scorer(model_key: str, path: str, table: np.ndarray, prior: np.ndarray) -> Scorer:
    """The scorer of this worker process; only the last model's is kept."""
    if model_key not in _last:
        _last.clear()
        _last[model_key] = Scorer(path, table, prior)
    return _last[model_key]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): score is the best language's share of the probability."""
    key, path, langs, table, prior = model.key, model.path, model.langs, model.table, model.prior

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(key, path, table, prior) if langs else None
        for batch in batches:
            pred, score = [], []
            for a in range(0, batch.num_rows, 64):
                texts = batch["text"][a:a + 64].to_pylist()
                known = [bool(langs) and t is not None and any(map(str.isalpha, t)) for t in texts]
                logs = scorer.scores([t.split() for t, k in zip(texts, known) if k]) if any(known) else np.zeros((0, 1))
                best = iter(logs.argmax(axis=1).tolist())
                share = iter((1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)).tolist() if len(logs) else [])
                for k in known:
                    pred.append(langs[next(best)] if k else "und")
                    score.append(next(share) if k else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["out"], pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out(id_col), F.lit(False)).alias("out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, **columns) -> DataFrame:
    """Fit on the labelled rows that are not held out, and predict every row."""
    return predict(docs, fit(docs, **columns))
