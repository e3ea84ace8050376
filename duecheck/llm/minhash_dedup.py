"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

Words are runs of letters, digits and characters beyond ASCII, lower-cased in
ASCII; a shingle is WIDTH words (a shorter text is one shingle). A shingle
weighs tf * (1 + IDF_SHARE * idf), idf scaled to 0..1 by the number of
documents. Document frequencies are counted over all documents in 2**18 hashed
buckets, as HashingTF does, so the table that is broadcast has a fixed size.
IDF_SHARE is small on purpose: a full idf would pull near copies of a widely
copied text apart, because what they share is then the common part.

Texts of one word sequence are collapsed first. Of each text left, SAMPLES
consistent weighted samples (Ioffe's ICWS) are drawn; two texts agree in a
sample with the probability of their weighted Jaccard similarity. Samples are
banded, and texts that agree in a band meet in a bucket. Candidates are verified
by weighted Jaccard similarity on the whole texts, linked at THRESHOLD or more,
and classes are the connected components of the links.

Buckets never emit all pairs. First each member meets the bucket's smallest one
(a star), and the links found are closed to components, by contraction within
tasks and pointer jumping between them. Only pairs of unlike
components are left then, in buckets that are several. Those outside a bucket's
largest component visit its other members, in blocks of a bounded number. There,
pairs that agree in LEAST_AGREED samples are verified on the spot, the best
first, until one links the two components; only the pairs of components linked
leave a block. There is no cap on partners or buckets.

Defined results: texts without words, null and empty ones among them, are
copies if their characters are equal. Repeated rows are copies. The smallest
doc_id of a class names it and stays; null ids come last. Other columns are
ignored. An empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duecheck.llm import words
from duecheck.llm.common import numbered, small_batches, split_by
from duecheck.sources.tables import stage

WIDTH = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 16, 5
SAMPLES = BANDS * BAND_ROWS
BUCKET_BITS = 18
#: Of SAMPLES. A pair at THRESHOLD agrees in fewer with a probability of 2 in 10,000; bands miss it in 17 of 10,000.
LEAST_AGREED = 52
BLOCK_ROWS = 1024
#: Edges that a task contracts at once.
EDGES = 1 << 20
IDF_SHARE = 0.25
_SLICE = 1024
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_RNG = np.random.default_rng(99)
_SEEDS = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_PLACES = _RNG.integers(0, 1 << 63, WIDTH, dtype=np.uint64) | np.uint64(1)
_SEQUENCE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each shingle, its text, two 64-bit hashes of each text's word sequence)."""
    n = len(offsets) - 1
    lower = words.LOWER[data]
    starts, ends = words.runs(words.ALNUM[data], offsets)
    owner = words.owners(starts, offsets)
    keys = words.hashes(lower, starts, ends)
    count = np.bincount(owner, minlength=n)
    first = np.cumsum(count) - count
    prints = np.zeros((n, 2), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        place = np.arange(len(keys)) - first[owner]
        for i, base in enumerate(_SEQUENCE):
            powers = np.cumprod(np.full(int(count.max()), base, np.uint64))
            prints[some, i] = np.add.reduceat(words.mix(keys + np.uint64(i)) * powers[place], first[some])
    bare = np.flatnonzero(count == 0)
    raw = bare[np.diff(offsets)[bare] > 0]
    prints[raw, 0] = words.hashes(data, offsets[raw], offsets[raw + 1])
    prints[raw, 1] = words.mix(prints[raw, 0] ^ np.uint64(1))
    # a shingle begins at every word that has WIDTH - 1 more behind it, and at the first of a shorter text
    size = np.where(count >= WIDTH, count - WIDTH + 1, np.minimum(count, 1))
    whose = np.repeat(np.arange(n), size)
    start = np.arange(len(whose)) - np.repeat(np.cumsum(size) - size, size) + first[whose]
    last = first[whose] + count[whose]
    out = np.zeros(len(whose), np.uint64)
    padded = np.concatenate((keys, np.zeros(WIDTH, np.uint64)))
    for i, p in enumerate(_PLACES):
        out += np.where(start + i < last, padded[start + i], np.uint64(0)) * p
    return words.mix(out), whose, prints


def weighted(hashed: np.ndarray, whose: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles, their text, their weight), by text and hash."""
    order = np.lexsort((hashed, whose))
    h, w = hashed[order], whose[order]
    at = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])))[: len(h)])
    tf = np.diff(np.append(at, len(h)))
    return h[at], w[at], tf * idf[(h[at] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]


def _uniform(x: np.ndarray, shift: int, bits: int) -> np.ndarray:
    """Bits of ``x`` as floats inside (0, 1)."""
    part = ((x >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.float32)
    part += np.float32(0.5)
    part *= np.float32(2.0**-bits)
    return part


def samples(h: np.ndarray, whose: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """For each text SAMPLES names; equal names are equal samples (shingle and step)."""
    out = np.full((n, SAMPLES), np.iinfo(np.uint64).max, np.uint64)
    log_weight = np.log(weight).astype(np.float32)[:, None]
    column = np.arange(SAMPLES)
    for low in range(0, len(h), _SLICE):
        part = slice(low, low + _SLICE)
        x = (h[part, None] ^ _SEEDS[None, :]) * _MIX[0]
        x ^= x >> np.uint64(29)
        x *= _MIX[1]
        x ^= x >> np.uint64(32)
        r = _uniform(x, 0, 10)
        r *= _uniform(x, 10, 10)
        np.log(r, out=r)
        np.negative(r, out=r)
        beta = _uniform(x, 20, 12)
        t = log_weight[part] / r
        t += beta
        np.floor(t, out=t)
        rank = _uniform(x, 32, 16)
        rank *= _uniform(x, 48, 16)
        np.log(rank, out=rank)
        np.negative(rank, out=rank)
        np.log(rank, out=rank)
        beta -= t
        beta -= 1
        beta *= r
        rank += beta
        # positive floats order like their bits; the low bits hold the place in the slice
        key = (rank.astype(np.float64) + 4096).view(np.uint64)
        key &= np.uint64(0xFFFFFFFFFF000000)
        key |= np.arange(len(x), dtype=np.uint64)[:, None]
        own = whose[part]
        at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        best = np.minimum.reduceat(key, at, axis=0)
        place = (best & np.uint64(0xFFFFFF)).astype(np.int64)
        step = t[place, column].astype(np.int64).astype(np.uint64)
        name = (words.mix(h[part][place]) + step * _SEQUENCE[0]) >> np.uint64(40)
        best = (best & np.uint64(0xFFFFFFFFFF000000)) | name
        out[own[at]] = np.minimum(out[own[at]], best)
    return out & np.uint64(0xFFFFFF)


def band_keys(sampled: np.ndarray) -> np.ndarray:
    """One key per text and band."""
    parts = sampled.reshape(len(sampled), BANDS, BAND_ROWS)
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sampled), 1))
    for i in range(BAND_ROWS):
        key = words.mix(key ^ (parts[:, :, i] << np.uint64(8)))
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two texts given as sorted distinct shingles and weights."""
    place = np.searchsorted(b[0], a[0])
    place[place == len(b[0])] = 0
    both = b[0][place] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    shared = np.minimum(a[1][both], b[1][place[both]]).sum()
    whole = a[1].sum() + b[1].sum() - shared
    return float(shared / whole) if whole else 1.0


def _texts(whole: DataFrame) -> DataFrame:
    return whole.select("row", "doc.doc_id", "doc.text")


def _profile(texts: DataFrame) -> DataFrame:
    """A row per document (row, doc_id, fp1, fp2), and per task a row per bucket (bucket, df)."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << BUCKET_BITS, np.int64)
        kind = None
        for batch in batches:
            hashed, whose, prints = shingles(*words.text_bytes(batch.column("text")))
            h, _, _ = weighted(hashed, whose, np.ones(1 << BUCKET_BITS))
            df += np.bincount((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(df))
            n, kind = batch.num_rows, batch.column("doc_id").type
            empty = pa.nulls(n, pa.int64())
            columns = [batch.column("row"), batch.column("doc_id"), *map(pa.array, prints.T.astype(np.uint64).copy().view(np.int64)), empty, empty]
            yield pa.RecordBatch.from_arrays(columns, names)
        used = np.flatnonzero(df)
        if len(used):
            empty = pa.nulls(len(used), pa.int64())
            columns = [empty, pa.nulls(len(used), kind), empty, empty, pa.array(used), pa.array(df[used])]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["row", "doc_id", "fp1", "fp2", "bucket", "df"]
    kind = texts.schema["doc_id"].dataType.simpleString()
    return stage(
        texts.mapInArrow(profile, f"row long, doc_id {kind}, fp1 long, fp2 long, bucket long, df long"), "profiles"
    )


def idf_weights(frequencies: DataFrame, documents: int, share: float = IDF_SHARE) -> np.ndarray:
    """The weight of a shingle in each bucket: 2**BUCKET_BITS numbers, however large the corpus."""
    counts = frequencies.groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(1 << BUCKET_BITS)
    df[counts.bucket.to_numpy(np.int64)] = counts.df
    scaled = np.log((documents + 1) / (np.minimum(df, documents) + 1)) / np.log(documents + 2)
    return 1 + share * scaled


def _signed(texts: DataFrame, idf) -> DataFrame:
    """(row, keys, sketch) of each text that has words: its bands, and 16 bits of each sample."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed, whose, _ = shingles(*words.text_bytes(batch.column("text")))
            if not len(hashed):
                continue
            has = np.unique(whose)
            sampled = samples(*weighted(hashed, whose, idf.value), batch.num_rows)[has]
            keys = pa.ListArray.from_arrays(
                np.arange(0, BANDS * len(has) + 1, BANDS, dtype=np.int32), pa.array(band_keys(sampled).ravel())
            )
            sketch = [r.tobytes() for r in sampled.astype("<u2")]
            rows = batch.column("row").to_numpy()[has]
            yield pa.RecordBatch.from_arrays([pa.array(rows), keys, pa.array(sketch, pa.binary())], ["row", "keys", "sketch"])

    return texts.select("row", "text").mapInArrow(sign, "row long, keys array<long>, sketch binary")


def _read(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of one text and their weights."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    hashed, whose, _ = shingles(raw, np.array([0, len(raw)]))
    h, _, w = weighted(hashed, whose, idf)
    return h, w


def _crossing(groups: DataFrame, idf) -> DataFrame:
    """Components (a, b) joined by a verified link of outsiders to others, within sorted groups of bounded size.

    A group holds members of one block of a bucket, and outsiders that visit it.
    An outsider is verified against all members of other components that agree
    with it in LEAST_AGREED samples, the best first, until one of a component is
    linked; the others of that component are then no news.
    """

    def links(component, row, main, visits, sketch, texts) -> Iterator[tuple]:
        known: dict[int, tuple] = {}

        def profile(i: int) -> tuple[np.ndarray, np.ndarray, float]:
            if i not in known:
                h, w = _read(texts[i], idf.value)
                known[i] = h, w, float(w.sum())
            return known[i]

        home = ~visits
        for i in np.flatnonzero(visits):
            # two outsiders meet in both their blocks; the smaller one asks
            other = np.flatnonzero(home & (component != component[i]) & (main | (row > row[i])))
            agreed = (sketch[other] == sketch[i]).sum(1)
            other, agreed = other[agreed >= LEAST_AGREED], agreed[agreed >= LEAST_AGREED]
            linked: set[int] = set()
            for j in other[np.lexsort((row[other], -agreed))]:
                if component[j] in linked:
                    continue
                (h, w, weight), (h2, w2, weight2) = profile(i), profile(j)
                if min(weight, weight2) < (THRESHOLD - 1e-9) * max(weight, weight2):
                    continue  # lengths alone keep them apart
                s = similarity((h, w), (h2, w2))
                if s >= THRESHOLD:
                    linked.add(component[j])
                    yield component[i], component[j]

    names = ("key", "block", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(whole: pa.Table) -> pa.RecordBatch:
            key, block, part, component, row, main, visits = (
                whole.column(c).to_numpy() for c in (*names, "component", "row", "main", "visits")
            )
            sketch = np.frombuffer(b"".join(whole.column("sketch").to_pylist()), "<u2").reshape(-1, SAMPLES)
            texts = whole.column("text").to_pylist()
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (part[1:] != part[:-1])))
            at = np.append(np.flatnonzero(new), len(key))
            found: list[tuple] = []
            for low, high in zip(at, at[1:]):
                cut = slice(low, high)
                found += links(component[cut], row[cut], main[cut].astype(bool), visits[cut].astype(bool), sketch[cut], texts[cut])
            a, b = zip(*found) if found else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = [batch.column(c)[-1].as_py() for c in names]
            whole = pa.Table.from_batches(held)
            open_ = np.ones(whole.num_rows, bool)
            for c, v in zip(names, last):
                open_ &= whole.column(c).to_numpy() == v
            if not open_.all():
                yield flush(whole.filter(pa.array(~open_)))
                held = whole.filter(pa.array(open_)).combine_chunks().to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    return groups.mapInArrow(run, "a long, b long")


def _shapes(several: DataFrame) -> DataFrame:
    """(key, largest, n, outside, blocks, parts) of each bucket: its largest component, members, outsiders, and blocks of both."""
    sizes = several.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", (-F.col("component")).alias("minus"))).alias("main")
    )
    outside = F.col("n") - F.col("main.n")
    blocks, parts = (F.greatest(F.lit(1), F.ceil(n / BLOCK_ROWS)).cast("int") for n in (F.col("n"), outside))
    shaped = largest.select(
        "key", (-F.col("main.minus")).alias("largest"), "n", outside.alias("outside"), blocks.alias("blocks"), parts.alias("parts")
    )
    return stage(shaped, "bucket-shapes")


def _links_across(
    several: DataFrame, shapes: DataFrame, signed: DataFrame, texts: DataFrame, idf, everywhere: bool, name: str
) -> DataFrame:
    """Pairs of unlike components that a verified link joins, within the buckets that hold several.

    Members lie in blocks of about BLOCK_ROWS. Those of the bucket's largest
    component stay in theirs; outsiders, in blocks of their own, visit all
    blocks, or at first only the one they are members of.
    """
    maybe, _ = split_by(texts.select("row", "text"), F.col("row"), several.select(F.col("row").alias("wanted")), "wanted")
    members = (
        several.join(shapes.select("key", "largest", "blocks", "parts"), "key")
        .join(signed.select("row", "sketch"), "row")
        .join(maybe, "row")
        .withColumn("main", F.col("component") == F.col("largest"))
    )
    own_block, own_part = (F.pmod(F.xxhash64("row"), c).cast("int") for c in ("blocks", "parts"))
    all_of = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    place = lambda block, part, visits: F.struct(
        block.alias("block"), part.alias("part"), F.lit(visits).alias("visits")
    )
    at_home = F.transform(all_of("parts"), lambda part: place(own_block, part, False))
    visited = F.when(F.col("main"), F.array().cast("array<int>")).otherwise(all_of("blocks") if everywhere else F.array(own_block))
    abroad = F.transform(visited, lambda block: place(block, own_part, True))
    each = members.withColumn("at", F.explode(F.concat(at_home, abroad)))
    rows = each.select("key", "at.*", "row", "component", "main", "sketch", "text")
    groups = rows.repartition("key", "block", "part").sortWithinPartitions("key", "block", "part", "row")
    return stage(_crossing(groups, idf), name)


def _verified(pairs: DataFrame, ids: DataFrame, texts: DataFrame, idf, name: str) -> DataFrame:
    """(a, b, s) of each pair of rows (a, b), all in ``ids``: the weighted Jaccard similarity of their whole texts."""
    maybe, _ = split_by(texts, F.col("row"), ids.select(F.col("row").alias("wanted")), "wanted")
    texts = stage(maybe.select("row", "text"), f"{name}-texts")

    read = lambda text: _read(text, idf.value)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, known = None, None
        for batch in batches:
            found = []
            columns = (batch.column(c).to_pylist() for c in ("a", "text_a", "text_b"))
            for a, text_a, text_b in zip(*columns, strict=True):
                if a != centre:
                    centre, known = a, read(text_a)
                found.append(similarity(known, read(text_b)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], ["a", "b", "s"])

    both = pairs.join(texts.withColumnsRenamed({"row": "b", "text": "text_b"}), "b").join(
        texts.withColumnsRenamed({"row": "a", "text": "text_a"}), "a"
    )
    return stage(both.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long, s double"), name)


def _hung(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, smallest row each is connected with) of all rows of the edges that are not the smallest themselves."""
    names, place = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(names))
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        for side in (root[a], root[b]):
            np.minimum.at(root, side, low)
        while (root[root] != root).any():
            root = root[root]
    hangs = np.flatnonzero(root != np.arange(len(names)))
    return names[hangs], names[root[hangs]]


def _contracted(edges: DataFrame, limit: int = EDGES) -> DataFrame:
    """Edges (u, v, fresh), u > v, replaced by stars within each run of ``limit`` edges; fresh where a run, now or before, was none.

    Where edges come sorted by u, all those of one u are seen together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            u, v, was = (np.concatenate(c) for c in zip(*held))
            stars = len(np.unique(u)) == len(np.unique(np.stack((u, v), 1), axis=0)) and not np.isin(v, u).any()
            fresh = not stars or bool(was.any())
            rows, centres = _hung(u, v)
            last = centres[np.searchsorted(rows, u[-1])]
            held[:] = [(u[-1:], np.array([last]), np.array([fresh]))]  # the last row may go on in the next run
            return pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(centres), pa.array(np.full(len(rows), fresh))], ["u", "v", "fresh"]
            )

        held: list[tuple] = []
        waiting = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v", "fresh")))
            waiting += batch.num_rows
            if waiting >= limit:
                yield flush()
                waiting = 0
        if waiting:
            yield flush()

    return edges.mapInArrow(run, "u long, v long, fresh boolean")


def stars(links: DataFrame) -> DataFrame:
    """(row, component) of all linked rows but the smallest of each component, which names it.

    Edges are contracted where they lie and again dealt by their larger row;
    then a row that hangs on one that hangs itself moves to the latter's
    smallest. Nothing moves any more once every component is a star.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    fresh = moved = True
    while True:
        dealt = _contracted(edges.select("u", "v", F.lit(False).alias("fresh"))).repartition("u").sortWithinPartitions("u")
        edges = stage(_contracted(dealt), "stars")
        fresh = not edges.where("fresh").isEmpty()
        if fresh or moved:
            low = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
            climbed = edges.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved"))
            edges = stage(climbed, "climbed-stars")
            moved = not edges.where("moved").isEmpty()
        if not (fresh or moved):
            return edges.select(F.col("u").alias("row"), F.col("v").alias("component"))


def components(links: DataFrame) -> DataFrame:
    """(row, component) of all linked rows; the smallest row names a component."""
    near = stars(links)
    return near.unionByName(near.select(F.col("component").alias("row"), "component").distinct())


def _merged(near: DataFrame, joined: DataFrame) -> DataFrame:
    """``near`` after some of its components, or rows that are none's, were joined to smaller ones."""
    further = joined.select(F.col("row").alias("component"), F.col("component").alias("next"))
    moved = near.join(further, "component", "left").select("row", F.coalesce("next", "component").alias("component"))
    return moved.unionByName(joined)


def near_classes(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles of all documents, first row of each word sequence, stars of the verified links between those rows)."""
    spark = texts.sparkSession
    small_batches(spark, 256)
    found = _profile(texts)
    rows = found.where("row is not null").select("row", "doc_id", "fp1", "fp2")
    firsts = stage(rows.groupBy("fp1", "fp2").agg(F.min("row").alias("first"), F.count("*").alias("n")), "firsts")
    idf = spark.sparkContext.broadcast(idf_weights(found.where("bucket is not null"), rows.count()))
    repeated = firsts.where("n > 1").select("fp1", "fp2", "first")
    copies = stage(rows.join(repeated, ["fp1", "fp2"]).where("row <> first").select(F.col("row").alias("copy")), "copies")
    maybe, sure = split_by(texts, F.col("row"), copies, "copy")
    checked = maybe.join(copies, maybe.row == copies.copy, "left_anti")
    signed = stage(_signed(sure.unionByName(checked), idf), "signatures")
    banded = signed.select("row", F.explode("keys").alias("key"))
    hubs = banded.groupBy("key").agg(F.min("row").alias("hub"), F.count("*").alias("n")).where("n > 1")
    met = stage(banded.join(hubs.select("key", "hub"), "key"), "buckets")
    star = met.where("row <> hub").select(F.col("hub").alias("a"), F.col("row").alias("b")).distinct()
    tested = _verified(star, met, texts, idf, "star-links")
    near = stars(tested.where(F.col("s") >= THRESHOLD))
    several = _open_buckets(met, near)

    # What is still apart is compared by its samples and verified, outsiders with all blocks of their bucket. Where that
    # is many more rows than members, the block they are members of comes first, and what it links need not visit.
    shapes = _shapes(several)
    home, all_ = shapes.agg(F.sum(F.expr("n * parts + outside")), F.sum(F.expr("n * parts + outside * blocks"))).first()
    if home is None:
        return rows, firsts, near
    if all_ > 2 * home:
        new = _links_across(several, shapes, signed, texts, idf, False, "links-in-blocks")
        if not new.isEmpty():
            near = _merged(near, stars(new))
            several = _open_buckets(met, near)
            shapes = _shapes(several)
    new = _links_across(several, shapes, signed, texts, idf, True, "links-across")
    return rows, firsts, near if new.isEmpty() else _merged(near, stars(new))


def _open_buckets(met: DataFrame, near: DataFrame) -> DataFrame:
    """(key, row, component) of the members of buckets with several components."""
    marked = met.join(near, "row", "left").withColumn("component", F.coalesce("component", "row")).drop("hub")
    marked = stage(marked, "marked-buckets")
    ends = marked.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return stage(marked.join(ends.where("low <> high").select("key"), "key"), "open-buckets")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: row, doc_id, class_id, class_size, kept."""
    return _near_dedup(_texts(numbered(docs, "near-dedup-texts", "doc_id, text")))


def _near_dedup(texts: DataFrame) -> DataFrame:
    rows, firsts, near = near_classes(texts)
    near = near.withColumnRenamed("row", "first")
    named = (
        rows.join(firsts.select("fp1", "fp2", "first"), ["fp1", "fp2"])
        .join(near, "first", "left")
        .select("row", "doc_id", F.coalesce("component", "first").alias("class_row"))
    )
    named = stage(named, "classed-rows")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    classes = named.groupBy("class_row").agg(F.min(order).alias("best"), F.count("*").alias("class_size"))
    return named.join(classes, "class_row").select(
        "row",
        "doc_id",
        F.col("best.doc_id").alias("class_id"),
        "class_size",
        (F.col("best.row") == F.col("row")).alias("kept"),
    )


def kept(docs: DataFrame) -> DataFrame:
    """One document of each class, with all columns; only rows that may be dropped are shuffled."""
    whole = numbered(docs, "near-dedup-documents")
    lost = stage(_near_dedup(_texts(whole)).where(~F.col("kept")).select(F.col("row").alias("lost")), "near-copies")
    maybe, sure = split_by(whole, F.col("row"), lost, "lost")
    checked = maybe.join(lost, F.col("row") == F.col("lost"), "left_anti")
    return sure.select("doc.*").unionByName(checked.select("doc.*"))
