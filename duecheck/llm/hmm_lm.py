"""LM scoring with a hidden Markov model over words, trained by Baum-Welch.

Tokens are lower-cased words and one end per text. Their counts over all training
texts are exact. Every seen word has emission counts of its own, one number per
state, so what is gathered grows with the words of the input. An unseen word has
its unigram share in all states. Before the first iteration, states differ by a
random draw for each of CLASSES hash classes of words; after it, by what each
word was seen with. A word's counts are drawn towards the mean of all words by
WORD_PRIOR tokens, so a rare word says little about the state.

Texts are packed into blocks of about BLOCK_TOKENS tokens. Each block asks for
the counts of its distinct words; requests meet by hash range, packed, so a word
however frequent is one entry per block. Baum-Welch reads all training tokens,
in segments of at most SEGMENT, at every iteration: each block sums expected
counts over its own vocabulary, they meet by the same hash ranges, and each block
gets the sums of its own words back. Only starts, moves and sums per state pass
the driver. No task holds more than a block's words or one hash range. Words'
expected counts are added up in 1024ths of a token per block, so sums agree in any order.
Scoring is exact for whole texts: a long text is cut into chunks whose transfer
matrices are computed side by side and then multiplied, with scaling throughout.

Defined results: null and empty texts are an end alone. Without training texts
all tokens are unknown, N and V are 0 and the states are told nothing. A null id
is in fold 0. Rows repeated are texts each. An empty table gives no rows. Words
are told apart by a 64-bit hash.
"""

import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duecheck.llm import words
from duecheck.llm.common import settings
from duecheck.sources.tables import stage, unstage

STATES, CLASSES, ITERATIONS = 8, 4096, 4
UNSEEN, END = CLASSES, CLASSES + 1
KINDS = CLASSES + 2
BLOCK_TOKENS = 1 << 21
REQUESTS = 1 << 20
SEGMENT, CHUNK, TOGETHER = 128, 256, 2048
ADDED = 0.1
PRIOR_TOKENS = 500.0
WORD_PRIOR = 8.0
_FIXED = float(1 << 20)
_WORD_FIXED = float(1 << 10)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize"

# Blocks are rows of megabytes: a row group ends after the first that fills it, not after 100 rows.
_ROW_GROUPS = {
    "parquet.block.size": str(8 << 20),
    "parquet.page.size.row.check.min": "1",
}

_BLOCK = "block string, doc_ids array<{id}>, train binary, sizes binary, tokens binary, vocabulary binary, counts binary"


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unpack(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _pack_whole(a: np.ndarray) -> bytes:
    """Whole numbers byte by byte: the high bytes, mostly zero, lie together."""
    return _pack(a.astype("<i8").reshape(-1, 1).view("u1").T)


def _unpack_whole(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(_unpack(b, "u1").reshape(8, -1).T).view("<i8").ravel()


def word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, number of words of each text)."""
    starts, ends = words.runs(~words.SPACE[data], offsets)
    keys = words.hashes(words.LOWER[data], starts, ends)
    return keys, np.bincount(words.owners(starts, offsets), minlength=len(offsets) - 1)


def _blocks(docs: DataFrame, train: Column) -> DataFrame:
    """One row per block: its texts, their words as places in the block's sorted vocabulary, training counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def block(held: list) -> pa.RecordBatch:
        keys = np.concatenate([k for k, *_ in held])
        sizes = np.concatenate([s for _, s, *_ in held])
        trained = np.concatenate([t for _, _, t, _ in held])
        vocabulary, tokens = np.unique(keys, return_inverse=True)
        counts = np.bincount(tokens[np.repeat(trained, sizes)], minlength=len(vocabulary))
        ids = pa.concat_arrays([i for *_, i in held])
        packed = [trained.astype("u1"), sizes.astype("<i8"), tokens.astype("<u4")]
        columns = [
            pa.array([uuid.uuid4().hex]),
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            *[pa.array([_pack(a)], pa.binary()) for a in packed],
            pa.array([vocabulary.astype("<u8").tobytes()], pa.binary()),
            pa.array([counts.astype("<i8").tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            keys, sizes = word_keys(*words.text_bytes(batch.column("text")))
            held.append((keys, sizes, batch.column("train").to_numpy(zero_copy_only=False), batch.column("doc_id")))
            if sum(len(k) for k, *_ in held) >= BLOCK_TOKENS:
                yield block(held)
                held = []
        if sum(len(s) for _, s, *_ in held):
            yield block(held)

    texts = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    return stage(texts.mapInArrow(run, _BLOCK.format(id=kind)), "token-blocks", _ROW_GROUPS)


def _class(keys: np.ndarray) -> np.ndarray:
    return (keys % np.uint64(CLASSES)).astype(np.int64)


def _requests(blocks: DataFrame, parts: int) -> DataFrame:
    """The distinct words of each block, packed by hash range."""
    cuts = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, v, c in zip(*(batch.column(x).to_pylist() for x in ("block", "vocabulary", "counts")), strict=True):
                vocabulary, counts = np.frombuffer(v, "<u8"), np.frombuffer(c, "<i8")
                edges = [0, *np.searchsorted(vocabulary, cuts), len(vocabulary)]
                rows = [
                    (p, name, vocabulary[a:b].tobytes(), _pack(counts[a:b])) for p, (a, b) in enumerate(zip(edges, edges[1:]))
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.binary(), pa.binary()))],
                    ["part", "block", "vocabulary", "counts"],
                )

    columns = blocks.select("block", "vocabulary", "counts")
    return columns.mapInArrow(run, "part int, block string, vocabulary binary, counts binary")


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one hash range: each block's words with their counts in all training texts and their places, and sums per class."""
    asked = [np.frombuffer(v, "<u8") for v in pdf.vocabulary]
    known, place = np.unique(np.concatenate(asked), return_inverse=True)
    counts = np.bincount(place, np.concatenate([_unpack(c, "<i8") for c in pdf["counts"]]), len(known)).astype("<i8")
    ends = np.cumsum([len(a) for a in asked])
    places = [place[e - len(a) : e] for a, e in zip(asked, ends, strict=True)]
    seen = counts > 0
    kind = _class(known[seen])
    sums = np.stack([np.bincount(kind, counts[seen], CLASSES), np.bincount(kind, minlength=CLASSES)]).astype("<i8")
    part = int(pdf.part.iloc[0])
    rows = [(b, part, _pack_whole(counts[p]), _pack_whole(np.diff(p, prepend=0)), None) for b, p in zip(pdf.block, places, strict=True)]
    columns = ["block", "part", "found", "places", "sums"]
    return pd.DataFrame([*rows, (None, part, None, None, sums.ravel().tolist())], columns=columns)


@dataclass
class Unigram:
    """Exact training counts, and their sums per class."""

    n: int
    v: int
    ends: int
    tokens: np.ndarray
    types: np.ndarray

    @property
    def whole(self) -> float:
        return self.n + ADDED * (self.v + 1)

    def log10(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ADDED) / self.whole)

    @property
    def class_share(self) -> np.ndarray:
        out = np.empty(KINDS)
        out[:CLASSES] = (self.tokens + ADDED * self.types) / self.whole
        out[UNSEEN] = ADDED / self.whole
        out[END] = (self.ends + ADDED) / self.whole if self.ends else 0  # never seen: one of the unseen
        return np.maximum(out, 1e-300)


def _known_blocks(blocks: DataFrame, replies: DataFrame, unigram: Unigram, kind: str) -> DataFrame:
    """One row per block: per text its base score, and its tokens as places among the block's seen words.

    Behind the seen words stand the unseen ones, as one, and the end.
    """
    ending = float(unigram.log10(np.array([unigram.ends]))[0])

    def run(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        b = block.iloc[0]
        found = found.sort_values("part")
        counts = np.concatenate([_unpack_whole(f) for f in found.found] or [np.zeros(0, "<i8")])
        places = [np.cumsum(_unpack_whole(p)) for p in found.places]
        vocabulary, sizes = np.frombuffer(b.vocabulary, "<u8"), _unpack(b.sizes, "<i8")
        tokens = _unpack(b.tokens, "<u4")
        seen = counts > 0
        number = np.where(seen, np.cumsum(seen) - 1, seen.sum()).astype("<u4")
        end = int(seen.sum()) + (unigram.ends > 0)
        each = np.split(seen, np.cumsum([len(p) for p in places])[:-1]) if places else []
        owner = np.repeat(np.arange(len(sizes)), sizes)
        base = np.bincount(owner, unigram.log10(counts)[tokens], len(sizes)) + ending
        known = np.bincount(owner, seen[tokens], len(sizes)) + (unigram.ends > 0)
        return pd.DataFrame(
            {
                "block": [b.block],
                "doc_ids": [b.doc_ids],
                "train": [b.train],
                "sizes": [_pack(sizes + 1)],
                "base": [_pack(base)],
                "known": [_pack(known.astype("<i8"))],
                "tokens": [_pack(np.insert(number[tokens], np.cumsum(sizes), end).astype("<u4"))],
                "classes": [_pack(_class(vocabulary[seen]).astype("<u2"))],
                "counts": [_pack_whole(counts[seen])],
                "places": [[_pack_whole(np.diff(p[s], prepend=0)) for p, s in zip(places, each, strict=True)]],
            }
        )

    schema = (
        f"block string, doc_ids array<{kind}>, train binary, sizes binary, base binary, known binary, "
        "tokens binary, classes binary, counts binary, places array<binary>"
    )
    joined = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(run, schema)
    return stage(joined, "word-blocks", _ROW_GROUPS)


@dataclass
class Hmm:
    """Start, transition and emission probabilities; emissions by word or class, then state."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def first(cls, share: np.ndarray, states: int = STATES) -> "Hmm":
        rng = np.random.default_rng(5)
        emit = share[:, None] * np.exp(rng.normal(0, 1, (KINDS, states)))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls.from_counts(np.full(states, 1.0), 1e6 * move, 1e9 * emit, share)  # far above the smoothing

    @classmethod
    def from_counts(cls, first: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray) -> "Hmm":
        """Expected counts, smoothed. Training never sees an unseen word: all states keep its unigram share."""
        emit = emit + PRIOR_TOKENS * share[:, None]
        emit[UNSEEN] = 0
        emit *= (1 - share[UNSEEN]) / np.maximum(emit.sum(0), 1e-300)
        emit[UNSEEN] = share[UNSEEN]
        first, move = first + 0.5, move + 0.5
        return cls(first / first.sum(), move / move.sum(1, keepdims=True), emit)


@dataclass
class WordModel:
    """What all blocks share of a model: starts, moves and sums over all words; emissions are made from a block's own counts."""

    unigram: Unigram
    start: np.ndarray
    move: np.ndarray
    use: np.ndarray
    end: np.ndarray
    whole: np.ndarray

    @classmethod
    def from_sums(cls, sums: np.ndarray, unigram: Unigram, states: int) -> "WordModel":
        """Of the sums that :func:`_block_counts` and :func:`_summed` give."""
        first, move, tokens, end, drawn, share = np.split(sums, np.cumsum([states, states * states, states, states, states]))
        tokens = tokens + 1e-9
        use = tokens / tokens.sum()
        end = drawn_counts(end[None, :], end.sum(keepdims=True), use)[0]
        first, move = first + 0.5, move.reshape(states, states) + 0.5
        whole = drawn + WORD_PRIOR * use * share[0] + end
        return cls(unigram, first / first.sum(), move / move.sum(1, keepdims=True), use, end, whole)

    def emissions(self, counted: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of some words, by their drawn expected counts and their counts in all training texts."""
        out = PRIOR_TOKENS * ((counts + ADDED) / self.unigram.whole)[:, None] + counted
        seen = 1 - ADDED / self.unigram.whole
        out *= seen / np.maximum(self.whole + PRIOR_TOKENS * seen, 1e-300)
        return out

    def hmm(self, parts: Iterable[np.ndarray], counts: np.ndarray) -> Hmm:
        """The model of one block, of the expected counts of its seen words in order; then the unseen ones and the end."""
        emit = np.empty((len(counts) + 2, len(self.start)))
        low = 0
        for expected in parts:
            part = slice(low, low := low + len(expected))
            emit[part] = self.emissions(drawn_counts(expected, expected.sum(1), self.use), counts[part])
        emit[-2] = ADDED / self.unigram.whole
        emit[-1] = self.emissions(self.end[None, :], np.array([self.unigram.ends]))[0]
        return Hmm(self.start, self.move, emit)


def drawn_counts(expected: np.ndarray, counts: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Expected counts of words per state, drawn towards the use of the states; each word keeps its count."""
    return (expected + WORD_PRIOR * use) * (counts / (counts + WORD_PRIOR))[:, None]


def first_hmm(unigram: Unigram, classes: np.ndarray, counts: np.ndarray, states: int) -> Hmm:
    """The model of one block before any training: a word has the random preference of its class."""
    share = unigram.class_share
    model = Hmm.first(share, states)
    own = (counts + ADDED) / unigram.whole / share[classes]
    emit = np.vstack([model.emit[classes] * own[:, None], model.emit[[UNSEEN, END]]])
    return Hmm(model.start, model.move, emit)


def _steps(tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """(order longest first, then per step the tokens of all rows that still run)."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    most = int(sizes[0]) if len(sizes) else 0
    running = np.searchsorted(-sizes, -np.arange(most), "left")
    return order, [tokens[starts[:n] + t] for t, n in enumerate(running)]


def expected_counts(model: Hmm, tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """Baum-Welch: expected starts, moves and emissions of the sequences, and their log likelihood."""
    kinds, states = model.emit.shape
    first, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((states, kinds))
    logs = 0.0
    for low in range(0, len(starts), TOGETHER):
        _, steps = _steps(tokens, starts[low : low + TOGETHER], sizes[low : low + TOGETHER])
        if not steps:
            continue
        ends = np.cumsum([len(seen) for seen in steps])
        post = np.empty((int(ends[-1]), states))
        alphas, scales = np.split(post, ends[:-1]), []  # views
        for t, seen in enumerate(steps):
            prior = alphas[t - 1][: len(seen)] @ model.move if t else model.start[None, :]
            np.multiply(prior, model.emit[seen], out=alphas[t])
            scale = alphas[t].sum(1, keepdims=True)
            alphas[t] /= scale
            scales.append(scale)
            logs += float(np.log(scale).sum())
        beta = np.ones((0, states))
        for t in range(len(steps) - 1, -1, -1):
            n = len(steps[t])
            full = np.ones((n, states))
            if t + 1 < len(steps):
                m = len(steps[t + 1])
                ahead = model.emit[steps[t + 1]] * beta / scales[t + 1]
                move += alphas[t][:m].T @ ahead
                full[:m] = ahead @ model.move.T
            beta = full
            alphas[t] *= beta  # from here on the posterior
        first += alphas[0].sum(0)
        seen = np.concatenate(steps)
        for s in range(states):
            emit[s] += np.bincount(seen, post[:, s], kinds)
        del post, alphas  # before the next ones are made
    return first, move * model.move, emit.T, logs


def _runs(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut each text into runs of at most ``most``: (text, start among all tokens, length)."""
    parts = (sizes + most - 1) // most
    text = np.repeat(np.arange(len(sizes)), parts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(np.cumsum(sizes) - sizes, parts) + nth * most
    return text, start, np.minimum(most, sizes[text] - nth * most)


def log_likelihoods(model: Hmm, tokens: np.ndarray, sizes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The exact natural log probability of each sequence, by the scaled forward recursion.

    The first chunk of a text runs from the start; later ones run from every state at once.
    """
    states = len(model.start)
    text, start, length = _runs(sizes, chunk)
    head = np.concatenate(([True], text[1:] != text[:-1]))[: len(text)]
    times = np.where(head, 1, states)
    row_chunk = np.repeat(np.arange(len(text)), times)
    first_row = np.cumsum(times) - times
    origin = np.arange(len(row_chunk)) - first_row[row_chunk]
    entry = np.where(head[row_chunk, None], model.start[None, :], model.move[origin])
    final, logs = np.empty((len(row_chunk), states)), np.zeros(len(row_chunk))
    for low in range(0, len(row_chunk), TOGETHER):
        part = row_chunk[low : low + TOGETHER]
        order, steps = _steps(tokens, start[part], length[part])
        a = entry[low : low + TOGETHER][order]
        scaled = np.zeros(len(part))
        for t, seen in enumerate(steps):
            n = len(seen)
            a[:n] = (a[:n] @ model.move if t else a[:n]) * model.emit[seen]
            if t % 8 == 7 or t + 1 == len(steps) or len(steps[t + 1]) < n:
                scale = a[:n].sum(1)
                a[:n] /= scale[:, None]
                scaled[:n] += np.log(scale)
        final[low + order], logs[low + order] = a, scaled
    out = np.zeros(len(sizes))
    carried = np.zeros(states)
    for c in range(len(text)):
        r = first_row[c]
        if head[c]:
            carried, out[text[c]] = final[r], logs[r]
            continue
        own = logs[r : r + states]
        top = own.max()
        carried = (carried * np.exp(own - top)) @ final[r : r + states]
        whole = carried.sum()
        carried = carried / whole
        out[text[c]] += top + np.log(whole)
    return out


def _block_model(b, found: pd.DataFrame | None, model: WordModel | Unigram, states: int) -> Hmm:
    counts = _unpack_whole(b.counts)
    if isinstance(model, Unigram):
        return first_hmm(model, _unpack(b.classes, "<u2"), counts, states)
    parts = found.sort_values("part").found
    return model.hmm((_unpack_whole(f).reshape(-1, states) / _WORD_FIXED for f in parts), counts)


def _block_counts(b, model: Hmm) -> pd.DataFrame:
    """Expected counts of one block: a row per hash range, and with one of them starts, moves and sums per state."""
    trained, sizes = _unpack(b.train, "u1").astype(bool), _unpack(b.sizes, "<i8")
    text, start, length = _runs(sizes, SEGMENT)
    use = trained[text]
    first, move, emit, _ = expected_counts(model, _unpack(b.tokens, "<u4"), start[use], length[use])
    # whole numbers add up alike in any order
    stats = np.rint(np.concatenate([first, move.ravel(), emit.sum(0), emit[-1]]) * _FIXED).astype(np.int64).tolist()
    own = zlib.crc32(b.block.encode()) % max(1, len(b.places))
    rows, low = [], 0
    for p, places in enumerate(b.places):
        fixed = np.rint(emit[low : (low := low + len(_unpack_whole(places)))] * _WORD_FIXED)
        rows.append((p, b.block, places, _pack_whole(fixed), stats if p == own else None))
    return pd.DataFrame(rows, columns=["part", "block", "places", "expected", "stats"])


def _summed(pdf: pd.DataFrame, states: int) -> pd.DataFrame:
    """Of one hash range: each block's words with their expected counts in all training texts, and sums for all blocks."""
    places = [np.cumsum(_unpack_whole(p)) for p in pdf.places]
    total = np.zeros((max((int(p[-1]) + 1 for p in places if len(p)), default=0), states), np.int64)
    for p, e in zip(places, pdf.expected, strict=True):
        total[p] += _unpack_whole(e).reshape(-1, states)
    counts = total.sum(1) / _WORD_FIXED
    share = counts / (counts + WORD_PRIOR)
    drawn = np.append(share @ total / _WORD_FIXED, share.sum()) * _FIXED
    stats = np.zeros(3 * states + states * states, np.int64)
    for s in pdf.stats:
        stats += 0 if s is None else np.asarray(s, np.int64)
    sums = np.concatenate([stats, np.rint(drawn).astype(np.int64)]).tolist()
    part = int(pdf.part.iloc[0])
    rows = [(b, part, _pack_whole(total[p]), None) for b, p in zip(pdf.block, places, strict=True)]
    return pd.DataFrame([*rows, (None, part, None, sums)], columns=["block", "part", "found", "sums"])


def train(blocks: DataFrame, unigram: Unigram, states: int = STATES, iterations: int = ITERATIONS) -> tuple[WordModel, DataFrame]:
    """Baum-Welch over all training texts of the blocks; one job per iteration. Also the last sums of each block's words."""
    counted = "part int, block string, places binary, expected binary, stats array<long>"
    columns = blocks.select("block", "train", "sizes", "tokens", "classes", "counts", "places")
    model, replies = unigram, None
    for _ in range(iterations):
        current = model

        def each(pdfs: Iterator[pd.DataFrame], model: WordModel | Unigram = current) -> Iterator[pd.DataFrame]:
            for pdf in pdfs:
                for b in pdf.itertuples():
                    yield _block_counts(b, _block_model(b, None, model, states))

        def both(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            b = block.iloc[0]
            return _block_counts(b, _block_model(b, found, current, states))

        if replies is None:
            expected = columns.mapInPandas(each, counted)
        else:
            expected = columns.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(both, counted)
        summed = expected.groupBy("part").applyInPandas(
            lambda pdf: _summed(pdf, states), "block string, part int, found binary, sums array<long>"
        )
        summed = stage(summed, "expected-counts", _ROW_GROUPS)
        places = summed.where("sums is not null").select(F.posexplode("sums").alias("place", "amount"))
        found = places.groupBy("place").agg(F.sum("amount").alias("amount")).toPandas()
        sums = np.zeros(4 * states + states * states + 1)
        sums[found.place.to_numpy(np.int64)] = found.amount / _FIXED
        model = WordModel.from_sums(sums, unigram, states)
        if replies is not None:
            unstage(replies)
        replies = summed.where("block is not null").drop("sums")
    return model, replies


def score_texts(docs: DataFrame, train_rows: Column, states: int = STATES, iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, trained, n_tokens, n_known, train_tokens, base_score, score of every text."""
    # shuffle files go when their table is stored; blocks are large rows, so few at once
    with settings(docs.sparkSession, {_CLEANUP: "true", _ARROW_ROWS: "512", _READ_ROWS: "512"}):
        return _score_texts(docs, train_rows, states, iterations)


def _score_texts(docs: DataFrame, train_rows: Column, states: int, iterations: int) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = _blocks(docs, train_rows)
    asked, texts = blocks.agg(F.sum(F.length("vocabulary")) / 8, F.sum(F.size("doc_ids"))).first()
    ends = int(docs.where(train_rows).count()) if texts else 0
    spark.conf.set(_ARROW_ROWS, "2")
    spark.conf.set(_READ_ROWS, "2")
    parts = max(1, int(-(-(asked or 0) // REQUESTS)))
    replies = stage(
        _requests(blocks, parts)
        .groupBy("part")
        .applyInPandas(_answer, "block string, part int, found binary, places binary, sums array<long>"),
        "word-counts",
        _ROW_GROUPS,
    )
    sums = replies.where("sums is not null").select(F.posexplode("sums").alias("place", "amount"))
    found = sums.groupBy("place").agg(F.sum("amount").alias("amount")).toPandas()
    per_class = np.zeros(2 * CLASSES)
    per_class[found.place.to_numpy(np.int64)] = found.amount
    tokens, types = np.split(per_class, 2)
    unigram = Unigram(int(tokens.sum()) + ends, int(types.sum()) + (ends > 0), ends, tokens, types)
    known = _known_blocks(blocks, replies.where("block is not null").drop("sums"), unigram, kind)
    unstage(blocks)
    unstage(replies)
    model, expected = train(known, unigram, states, iterations)

    def run(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        b = block.iloc[0]
        sizes = _unpack(b.sizes, "<i8")
        logs = log_likelihoods(_block_model(b, found, model, states), _unpack(b.tokens, "<u4"), sizes) / np.log(10)
        return pd.DataFrame(
            {
                "doc_id": pd.Series(list(b.doc_ids), dtype=object),
                "trained": _unpack(b.train, "u1").astype(bool),
                "n_tokens": sizes,
                "n_known": _unpack(b.known, "<i8"),
                "train_tokens": unigram.n,
                "base_score": _unpack(b.base, "<f8"),
                "score": logs,
            }
        )

    scored = known.groupBy("block").cogroup(expected.groupBy("block")).applyInPandas(
        run,
        f"doc_id {kind}, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return stage(scored, "scored-texts")
