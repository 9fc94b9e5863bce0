"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification.

A text is the set of its five-word shingles, weighted by how often they occur: from 1 for one
occurrence up to ``1 + REPEATS``, which no number of occurrences exceeds. Links are decided on plain
sets, so weights that could grow would hide a pair of which one side repeats a line. Every shingle is
a Poisson process with its weight as rate, whose arrivals fall on random registers; a register keeps
the shingle of its earliest arrival, so two registers agree with the probability Jaccard similarity
of the weighted sets. A shingle's arrivals are generated only until they come later than every
register's best, which ends almost all of them after the first.

Equal texts are collapsed first. Signatures are cut into bands; texts that share a band meet in a
bucket. No bucket is expanded into all its pairs: each member is verified against the bucket's leader, the
links are contracted to components, and only where a bucket holds several components are members
outside the leader's compared with the rest, in cells of bounded size that return links only.
A text is known by its smallest id and its hash, so unlike texts that share an id stay apart.
Verification is exact: the Jaccard similarity of the shingle sets must reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.llm.components import components
from askgrid.llm.encoding import slices, tidy
from askgrid.plans.shared import written

WORDS = 5
SIMILARITY = 0.8
BANDS = 26
ROWS = 5
#: How much the weight of a shingle can rise by repeats.
REPEATS = 0.25
CELL_MEMBERS = 1_000
#: Text per signature batch: its rounds cost the same for a small one.
SLICE_BYTES = 4 << 20
_COLUMNS = 4_096
_MASK = (1 << 44) - 1
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# --- shingles -----------------------------------------------------------------------------------

def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, with repeats, and the text each belongs to.

    Words are separated by white space. A text of fewer words is one shingle; none has none.
    """
    split = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded = split.flatten().dictionary_encode()
    different = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, different), np.uint64, len(different))
    # Leading and trailing white space leave empty words behind.
    filled = np.fromiter(map(bool, different), bool, len(different))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)),
                      pc.list_value_length(split).to_numpy(zero_copy_only=False))
    if codes.size and not filled.all():
        real = filled[codes]
        codes, owner = codes[real], owner[real]
    word = hashes[codes] if codes.size else np.empty(0, np.uint64)
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    runs = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(texts)), runs)
    start = np.arange(doc.size) - np.repeat(np.cumsum(runs) - runs, runs) + first[doc]
    short = count[doc] < words
    out = np.zeros(doc.size, np.uint64)
    for j in range(words):
        at = start + j
        if short.any():
            inside = ~short | (j < count[doc])
            value = np.where(inside, word[np.minimum(at, word.size - 1)], np.uint64(j))
        else:
            value = word[at]
        out += value * _ODD[j % len(_ODD)] + np.uint64(j)
        out ^= out >> np.uint64(29)
    return _mix(out), doc


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Flat ascending different hashes of each text, and offsets."""
    hashes, doc = shingles(texts, words)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    fresh = np.ones(doc.size, bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    sizes = np.bincount(doc[fresh], minlength=len(texts))
    return hashes[fresh], np.concatenate([[0], np.cumsum(sizes)])


# --- signatures ---------------------------------------------------------------------------------

def prob_minhash(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int,
                 registers: int) -> np.ndarray:
    """Signatures (docs x registers) of weighted sets, all sets of a batch at a time.

    ``element`` are hashes, different within a set; sets without elements keep zeros.
    """
    best = np.full(docs * registers, np.inf)
    held = np.zeros(docs * registers, np.uint64)
    time = np.zeros(element.size)
    pace = 1.0 / weight
    latest = np.full(docs, np.inf)
    single = np.bincount(doc, minlength=docs)[doc] == 1
    if single.any():  # one element owns every register
        held.reshape(docs, registers)[doc[single]] = element[single][:, None]
        more = ~single
        element, doc, time, pace = element[more], doc[more], time[more], pace[more]
    step = 0
    while element.size:
        turn = np.uint64(int(_ODD[0]) * (2 * step + 1) & (1 << 64) - 1)
        draw = _mix(element + turn)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) * pace
        alive = time < latest[doc]
        element, doc, time, pace = element[alive], doc[alive], time[alive], pace[alive]
        if not element.size:
            break
        pick = _mix(draw[alive] + _ODD[1])
        at = doc * registers + ((pick >> np.uint64(32)) * np.uint64(registers)
                                >> np.uint64(32)).astype(np.int64)
        np.minimum.at(best, at, time)
        won = best[at] == time
        held[at[won]] = element[won]
        touched = np.unique(doc) if step else slice(None)
        latest[touched] = best.reshape(docs, registers)[touched].max(axis=1)
        step += 1
    return held.reshape(docs, registers)


def _signatures(words: int, bands: int, rows: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, size in slices(batch.column(2), SLICE_BYTES):
                hashes, doc = shingles(batch.column(2).slice(first, size), words)
                packed = (doc.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20))
                packed.sort()
                fresh = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) \
                    if packed.size else np.empty(0, np.int64)
                counts = np.diff(np.append(fresh, packed.size))
                packed = packed[fresh]
                owner = (packed >> np.uint64(44)).astype(np.int64)
                signature = prob_minhash(
                    _mix(packed & np.uint64(_MASK)), 1.0 + REPEATS * (1.0 - 1.0 / counts),
                    owner, size, bands * rows).reshape(size, bands, rows)
                code = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _ODD[2],
                                       (size, bands)).copy()
                for r in range(rows):
                    code = _mix(code + signature[:, :, r] * _ODD[3])
                filled = np.bincount(owner, minlength=size) > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(filled, bands, 0))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, size), batch.column(1).slice(first, size),
                     pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)),
                                              pa.array(code[filled].ravel().view(np.int64)))],
                    names=["doc_id", "text_key", "bands"])

    return run


def _sets(words: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, size in slices(batch.column(1)):
                hashes, offsets = shingle_sets(batch.column(1).slice(first, size), words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, size),
                     pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)),
                                              pa.array(hashes.view(np.int64)))],
                    names=["id", "hashes"])

    return run


# --- linking ------------------------------------------------------------------------------------

def _similarity(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Add the exact Jaccard similarity of the sets of ``a`` and ``b``."""
    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a").join(right, "b")
        .withColumn("common", common)
        .select("a", "b", (F.col("common") / (F.size("x") + F.size("y") - F.col("common")))
                .alias("similarity")))


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of ``x`` shares with each of ``y``."""
    if len(x) * len(y) <= 64:
        return np.array([[np.intersect1d(a, b, assume_unique=True).size for b in y] for a in x])
    flat_x, flat_y = np.concatenate(x), np.concatenate(y)
    common = np.intersect1d(flat_x, flat_y)

    def places(flat: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(sets)), [s.size for s in sets])
        at = np.searchsorted(common, flat)
        here = (at < common.size) & (common[np.minimum(at, common.size - 1)] == flat) \
            if common.size else np.zeros(flat.size, bool)
        return owner[here], at[here]

    (own_x, at_x), (own_y, at_y) = places(flat_x, x), places(flat_y, y)
    counts = np.zeros((len(x), len(y)), np.float32)
    for lo in range(0, common.size, _COLUMNS):
        blocks = []
        for size, owner, at in ((len(x), own_x, at_x), (len(y), own_y, at_y)):
            block = np.zeros((size, _COLUMNS), np.float32)
            inside = (at >= lo) & (at < lo + _COLUMNS)
            block[owner[inside], at[inside] - lo] = 1
            blocks.append(block)
        counts += blocks[0] @ blocks[1].T
    return counts.astype(np.int64)


def _cell_links(similarity: float):
    """Links between the two sides of a cell: for each member one per component it reaches."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        sides = []
        for table in (left, right):
            hashes = table.column("hashes").combine_chunks()
            offsets = hashes.offsets.to_numpy()
            flat = hashes.values.to_numpy(zero_copy_only=False)
            sides.append((table.column("id").to_pylist(), table.column("root").to_pylist(),
                          [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]))
        (ids_x, root_x, x), (ids_y, root_y, y) = sides
        number = {root: i for i, root in enumerate({*root_x, *root_y})}
        if len(number) == 1:
            return schema.empty_table()
        root_x, root_y = (np.array([number[r] for r in roots]) for roots in (root_x, root_y))
        shared = _overlaps(x, y)
        total = np.array([s.size for s in x])[:, None] + np.array([s.size for s in y]) - shared
        row, column = np.nonzero(
            (shared >= similarity * total - 1e-9) & (root_x[:, None] != root_y))
        pairs = {(int(r), int(root_y[c])): int(c) for r, c in zip(row, column)}
        ends = [(ids_x[r], ids_y[c]) for (r, _), c in pairs.items()]
        return pa.table([[min(e) for e in ends], [max(e) for e in ends]], schema=schema)

    return run


def _missing_links(placed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links that the stars did not see, from ``band, id, root, outside``.

    Only buckets with members outside the leader's component take part. Members outside are dealt to
    slabs by hash, and so are all members; each pair of slabs is a task. A bucket with few members
    outside copies its members only as often as those fill slabs.
    """
    mixed = placed.groupBy("band").agg(
        F.ceil(F.count_if("outside") / CELL_MEMBERS).cast("int").alias("lefts"),
        F.ceil(F.count(F.lit(1)) / CELL_MEMBERS).cast("int").alias("rights")).where("lefts > 0")
    rows = placed.join(mixed, "band").join(sets, "id")

    def own(slabs: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(slabs)).cast("int")

    def every(slabs: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(slabs) - 1))

    left = rows.where("outside").select(
        "band", own("lefts").alias("i"), every("rights").alias("j"), "id", "root", "hashes")
    # Columns of its own, or the two sides of the cogroup count as one.
    right = rows.select(
        F.col("band").alias("band"), every("lefts").alias("i"), own("rights").alias("j"),
        F.col("id").alias("id"), F.col("root").alias("root"), F.col("hashes").alias("hashes"))
    cell = ["band", "i", "j"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(
        _cell_links(similarity), "a binary, b binary").distinct()


def _node(doc_id: Column, text_key: Column) -> Column:
    """16 bytes that sort by id, then by text hash."""
    flipped = doc_id.bitwiseXOR(F.lit(-(1 << 63)))
    return F.unhex(F.concat(F.lpad(F.hex(flipped), 16, "0"), F.substring(text_key, 1, 16)))


def _id_of(node: Column) -> Column:
    flipped = F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("bigint")
    return flipped.bitwiseXOR(F.lit(-(1 << 63)))


def _classes(texts: DataFrame, similarity: float, words: int, bands: int, rows: int
             ) -> tuple[DataFrame, DataFrame]:
    """Of ``doc_id, text``: ``doc_id, text_key`` of every row, ``text_key, id, root`` of every text."""
    keyed = texts.select("doc_id", F.md5("text").alias("text_key"), "text")
    signed = written(keyed.mapInArrow(
        _signatures(words, bands, rows),
        "doc_id bigint, text_key string, bands array<bigint>"))
    # One text each: copies meet before anything is compared, summed up ahead of the shuffle.
    originals = written(signed.groupBy("text_key").agg(
        F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")).select(
        "text_key", _node(F.col("doc_id"), F.col("text_key")).alias("id"), "bands"))
    entries = originals.where("id is not null").select("id", F.explode("bands").alias("band"))
    buckets = entries.groupBy("band").agg(
        F.count(F.lit(1)).alias("members"),
        F.min(F.struct(F.xxhash64("id", "band").alias("h"), "id")).alias("l"),
    ).where("members > 1").select("band", F.col("l.id").alias("leader"))
    met = written(entries.join(buckets, "band").select("band", "id", "leader"))

    involved = met.select("id").distinct()
    sets = written(
        keyed.select(_node(F.col("doc_id"), F.col("text_key")).alias("id"), "text")
        .join(involved, "id").dropDuplicates(["id"])
        .mapInArrow(_sets(words), "id binary, hashes array<bigint>"))
    spokes = met.where("id <> leader").select(
        F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    verified = written(_similarity(spokes, sets))
    links = verified.where(F.col("similarity") >= similarity).select("a", "b")
    roots = written(components(links))

    # Pairs of different components that share a bucket, one of them outside the leader's.
    with_root = met.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn(
        "root", F.coalesce("root", "id"))
    leader_root = roots.select(F.col("node").alias("leader"), F.col("root").alias("leader_root"))
    placed = written(with_root.join(leader_root, "leader", "left").select(
        "band", "id", "root",
        (F.col("root") != F.coalesce("leader_root", "leader")).alias("outside")))
    more = _missing_links(placed, sets, similarity)
    closed = components(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))
                        .unionByName(more))
    classes = originals.select("text_key", "id").join(
        closed.select(F.col("node").alias("id"), "root"), "id", "left").select(
        "text_key", "id", F.coalesce("root", "id").alias("root"))
    return signed.select("doc_id", "text_key"), classes


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    words: int = WORDS,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``doc_id, class_id`` of every row; a class is named by its smallest id.

    Two texts are linked if their sets of ``words``-word shingles have a Jaccard similarity of at
    least ``similarity``; a class is a component of links. Equal texts are always in one class, so
    empty texts (and nulls, which count as empty) are one class. Different texts without any word
    are not linked. A row with a null id has the class of the equal texts that have ids, else null.
    Repeated rows are copies. Unlike texts that share an id are compared each, so their classes may
    have the same name. Other columns are not read. An empty table gives no rows.
    """
    keys, classes = _classes(_texts(docs, id_col, text_col), similarity, words, bands, rows)
    named = classes.select("text_key", _id_of(F.col("root")).alias("class_id"))
    return keys.join(named, "text_key").select("doc_id", "class_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS,
             rows: int = ROWS) -> DataFrame:
    """``docs`` with one row of each class, that of its smallest id, and its own columns only.

    Of unlike texts that share an id each is kept, of rows that repeat id and text one. Rows with
    null ids stay.
    """
    _, classes = _classes(_texts(docs, id_col, text_col), similarity, words, bands, rows)
    key = "_node"
    while key in docs.columns:
        key += "_"
    kept = classes.where("id = root").select(F.col("id").alias(key))
    named = docs.where(F.col(id_col).isNotNull()).withColumn(key, _node(
        F.col(id_col).cast("bigint"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    one = named.join(kept, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
    return one.unionByName(docs.where(F.col(id_col).isNull()))
