"""Near duplicates by min-max hashing.

Each permutation of a document's shingle hashes yields its minimum and its
maximum, so ``permutations`` evaluations give twice as many signature values.
Bands of ``rows`` values retrieve candidates; every link is confirmed on the
full shingle sets.  At a similarity of 0.8, 24 bands of 4 independent values
miss a pair with probability (1 - 0.8^4)^24 < 4e-6.  A permutation's minimum
and maximum are not independent in small sets: measured with these signatures,
the rate is 2.2e-5 for a union of 5 shingles, 7.7e-6 for 10 and 5.7e-6 for 20.

Order of work, so that large groups stay linear:

1.  Documents with the same shingle set form a class (128-bit set hash).
2.  Each class proposes one link, to the smallest member of the band buckets
    it shares most often; confirmed links give first components.
3.  Buckets whose members all lie in one component are done.  In the others
    the members' full sets meet in one block, where one pass over the block
    counts the shingles that a row shares with every row of other components.
    A link joins the two components in the block at once, so pairs within one
    component are not compared and a block emits fewer links than it has
    components, however many pairs it holds.
4.  A bucket of more than ``block`` shingles whose largest component leaves no
    more than ``block`` to the others is dealt over blocks: each row of the
    largest component to one, the few other rows to all.
5.  Any other large bucket is banded again, on 47 further groups of 4 values of
    the signature (a pair at 0.8 that is in the bucket misses them all with a
    probability below 1e-5).  What is still too large is compared in a grid of
    blocks, each pair of parts once: an exact way for the rest, with no cap.

Nulls: a null text counts as empty; empty documents are linked with nothing.
A null id takes part in links, but a component's id is its smallest non-null
id (null if it has none).  Repeated rows are separate documents of one class.
Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .kernel import mix, shingles, word_hashes
from .storage import discard, materialize

BLOOM_BITS = 23


def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return seed[:k] | np.uint64(1), seed[k:]


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum and maximum of each permutation of ``s``, interleaved; bounded memory for long texts."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(a), np.uint64)
    for at in range(0, len(s), 4096):
        x = a[:, None] * s[None, at : at + 4096] + b[:, None]
        np.minimum(low, x.min(1), out=low)
        np.maximum(high, x.max(1), out=high)
    return np.stack([low, high], 1).ravel()


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s + np.uint64(0x51)).sum().astype(np.int64)), int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().astype(np.int64))


def sketch(docs: DataFrame, id_col: str, text_col: str, words: int, permutations: int, rows: int) -> DataFrame:
    """(doc_id, rid, n, h1, h2, sig, bands): one row a document; sig and bands only at a class's first row in a task."""

    def run(batches):
        a, b = _permutations(permutations)
        bands = 2 * permutations // rows
        task, count, seen = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            ids = batch.column(0)
            for row, counts, hashes in word_hashes(batch.column(1)):
                out = {k: [] for k in ("rid", "n", "h1", "h2", "sig", "bands")}
                for s in shingles(hashes, counts, words):
                    h = _set_hash(s)
                    out["rid"].append((task << 33) | count)
                    count += 1
                    out["n"].append(len(s))
                    out["h1"].append(h[0])
                    out["h2"].append(h[1])
                    if len(s) and h not in seen:
                        if len(seen) < 1 << 17:
                            seen.add(h)
                        v = signature(s, a, b)
                        key = np.arange(bands, dtype=np.uint64)
                        for k in range(rows):
                            key = mix(key * np.uint64(0x9FB21C651E98DF25) + v[k::rows][:bands])
                        out["sig"].append((mix(v) & np.uint64(0xFFFF)).astype("<u2").tobytes())
                        out["bands"].append(key.astype(np.int64))
                    else:
                        out["sig"].append(None)
                        out["bands"].append(None)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(counts)).cast(pa.int64()), pa.array(out["rid"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["h1"], pa.int64()), pa.array(out["h2"], pa.int64()), pa.array(out["sig"], pa.binary()), pa.array(out["bands"], pa.list_(pa.int64()))],
                    ["doc_id", "rid", "n", "h1", "h2", "sig", "bands"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, rid long, n long, h1 long, h2 long, sig binary, bands array<long>")


def _bloom(keys: DataFrame) -> bytes:
    """A filter of 2^BLOOM_BITS bits over the column ``h1``: its size is fixed, whatever the number of keys."""
    bit = F.shiftrightunsigned(F.col("h1"), 64 - BLOOM_BITS) + 1  # the bitmap functions count positions from 1
    parts = keys.select(bit.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect()
    out = bytearray(1 << (BLOOM_BITS - 3))
    for r in parts:  # at most 2^BLOOM_BITS / 32768 rows
        at = (r["k"] - 1) * 4096
        for i, v in enumerate(r["bits"]):
            out[at + i] |= v
    return bytes(out)


def shingle_sets(docs: DataFrame, text_col: str, words: int, wanted: DataFrame) -> DataFrame:
    """(h1, h2, items): the full shingle sets of the classes in ``wanted`` (h1); false positives of the filter stay in."""
    bits = docs.sparkSession.sparkContext.broadcast(_bloom(wanted))

    def run(batches):
        filter_, seen = np.frombuffer(bits.value, np.uint8), set()
        for batch in batches:
            for _, counts, hashes in word_hashes(batch.column(0)):
                h1, h2, items = [], [], []
                for s in shingles(hashes, counts, words):
                    if not len(s):
                        continue
                    h = _set_hash(s)
                    x = (h[0] & 0xFFFFFFFFFFFFFFFF) >> (64 - BLOOM_BITS)
                    if not (filter_[x >> 3] >> (x & 7)) & 1 or h in seen:
                        continue
                    if len(seen) < 1 << 17:
                        seen.add(h)
                    h1.append(h[0])
                    h2.append(h[1])
                    items.append(s.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(items, pa.list_(pa.int64()))], ["h1", "h2", "items"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "h1 long, h2 long, items array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """Of ``pairs`` (src, dst) of classes, those with whole * intersection >= part * union on ``sets`` (cid, n, items)."""
    a = sets.select(F.col("cid").alias("src"), F.col("n").alias("na"), F.col("items").alias("sa"))
    b = sets.select(F.col("cid").alias("dst"), F.col("n").alias("nb"), F.col("items").alias("sb"))
    both = pairs.join(a, "src").join(b, "dst").where(whole * F.least("na", "nb") >= part * F.greatest("na", "nb"))
    both = both.withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(whole * F.col("common") >= part * (F.col("na") + F.col("nb") - F.col("common"))).select("src", "dst")


def _block_links(part: int, whole: int):
    """Links (src, dst) between labels in each block of rows (band, i, j, side, cid, label, items), sorted by block.

    Links that the ones before them already imply are left out, so a block emits fewer than it has labels.  In a
    block with i <> j, rows of one side are not compared: they meet in another block.
    """

    def of(side, cid, label, edge, flat):
        size = np.diff(edge)
        label = label.copy()
        code = np.unique(flat, return_inverse=True)[1]
        mark = np.zeros(int(code.max()) + 1 if len(code) else 0, bool)
        for i in range(len(cid) - 1):
            rest = size[i + 1 :]
            near = (label[i + 1 :] != label[i]) & (whole * rest >= part * size[i]) & (whole * size[i] >= part * rest)
            if side is not None:
                near &= side[i + 1 :] != side[i]
            near = np.flatnonzero(near) + i + 1
            if not len(near):
                continue
            own = code[edge[i] : edge[i + 1]]
            mark[own] = True
            n = size[near]
            begin = np.cumsum(n) - n
            at = np.arange(int(n.sum())) + np.repeat(edge[near] - begin, n)
            common = np.add.reduceat(mark[code[at]], begin, dtype=np.int64)
            mark[own] = False
            for j in near[whole * common >= part * (n + size[i] - common)].tolist():
                if label[j] != label[i]:
                    yield int(cid[i]), int(cid[j])
                    label[label == label[j]] = label[i]

    def block(rows):
        keys, side, cid, label, items = ([r[k] for r in rows] for k in range(5))
        label = np.concatenate(label)
        if (label == label[0]).all():
            return
        cross = keys[0][0, 1] != keys[0][0, 2]
        size = np.concatenate([np.diff(offsets) for offsets, _ in items])
        yield from of(np.concatenate(side) if cross else None, np.concatenate(cid), label, np.r_[0, np.cumsum(size)], np.concatenate([values for _, values in items]))

    def run(batches):
        held, found = [], []

        def links():
            out = pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["src", "dst"])
            found.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys)]
            side, cid, label, items = batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5).to_numpy(), batch.column(6)
            offsets, values = items.offsets.to_numpy(), items.values.to_numpy()
            for a, z in zip(cuts[:-1], cuts[1:]):
                if held and (held[0][0][0] != keys[a]).any():
                    found += block(held)
                    held = []
                held.append((keys[a:z], side[a:z], cid[a:z], label[a:z], (offsets[a : z + 1], values[offsets[a] : offsets[z]])))
            held[-1] = tuple(x.copy() if k < 4 else (x[0].copy(), x[1].copy()) for k, x in enumerate(held[-1]))
            if len(found) >= 1 << 16:
                yield links()
        if held:
            found += block(held)
        yield links()

    return run


def _dealt(rows: DataFrame, block: int, last: bool) -> tuple[DataFrame, DataFrame]:
    """(rows with their blocks, the rest) of ``rows`` (band, cid, label, n) in buckets that hold several labels.

    The rest, none if ``last``, are rows of buckets too large for one block and not mostly of one label.
    """
    weight = F.sum(F.col("n") + 64)
    each = rows.groupBy("band", "label").agg(weight.alias("w"))
    top = F.max_by("label", F.struct("w", "label")).alias("top")
    bucket = materialize(each.groupBy("band").agg(top, F.max("w").alias("wtop"), F.sum("w").alias("w"), F.count("*").alias("k")).where("k > 1").drop("k"), "mixed")
    mixed = rows.join(bucket, "band")
    small, lopsided = F.col("w") <= block, F.col("w") - F.col("wtop") <= block
    parts = F.ceil(F.col("w") / block).cast("long")
    mine, none = F.pmod(F.xxhash64("cid"), parts), F.lit(-1).cast("long")

    def at(i, j, side):
        return F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), side.cast("long").alias("side"))

    zero, every = F.lit(0), F.sequence(F.lit(0).cast("long"), parts - 1)
    own = F.when(mine == 0, at(zero, zero, zero)).otherwise(at(mine, none, zero))
    others = F.transform(every, lambda p: F.when(p == 0, at(zero, zero, zero)).otherwise(at(p, none, F.lit(1))))
    where = F.when(small, F.array(at(zero, zero, zero))).when(lopsided, F.when(F.col("label") == F.col("top"), F.array(own)).otherwise(others))
    if last:
        where = where.otherwise(F.transform(every, lambda o: at(F.least(mine, o), F.greatest(mine, o), mine)))
    out = mixed if last else mixed.where(small | lopsided)
    out = out.select("band", "cid", "label", F.explode(where).alias("at")).select("band", "at.i", "at.j", "at.side", "cid", "label")
    return out, mixed.where(~(small | lopsided) & F.lit(not last)).select(*rows.columns)


def _banded_again(rows: DataFrame, sketches: DataFrame, permutations: int, width: int) -> DataFrame:
    """``rows`` (band, pos, cid, label, n) under longer keys: the band and ``width`` further values of the signature."""
    values, bands = 2 * permutations, 2 * permutations // width
    next_to = [[g * width + k for k in range(width)] for g in range(bands)]
    apart = [[g + k * bands for k in range(width)] for g in range(bands)]
    value = [F.substring("sig", 2 * v + 1, 2) for v in range(values)]
    keys = [F.when(F.lit(g) != F.col("pos"), F.xxhash64("band", F.lit(g), *[value[v] for v in group])) for g, group in enumerate(next_to + apart)]
    again = rows.join(sketches.select("cid", "sig"), "cid").select("cid", "label", "n", F.explode(F.array(*keys)).alias("band"))
    return again.where("band is not null")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, part: int = 80, whole: int = 100, permutations: int = 48, rows: int = 4, block: int = 1 << 21) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row a document; see the module for the method and edge cases."""
    rowsets = materialize(sketch(docs, id_col, text_col, shingle_words, permutations, rows), "sketch")
    classes = materialize(rowsets.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("low_id")), "classes")
    first = rowsets.where("bands is not null").join(classes.select("cid", F.col("cid").alias("rid")), "rid", "left_semi")
    banded = materialize(first.select(F.col("rid").alias("cid"), "n", F.posexplode("bands").alias("pos", "band")), "bands")
    shared = materialize(banded.groupBy("band").agg(F.min("cid").alias("center"), F.count("*").alias("m")).where("m > 1").drop("m"), "buckets")
    members = materialize(banded.join(shared, "band"), "members")
    discard(banded)
    discard(shared)
    paired = classes.join(members.select("cid").distinct(), "cid", "left_semi").select("cid", "h1", "h2", "n")
    items = shingle_sets(docs, text_col, shingle_words, paired).groupBy("h1", "h2").agg(F.any_value("items").alias("items"))
    sets = materialize(items.join(paired, ["h1", "h2"]).select("cid", "n", "items"), "sets")

    votes = members.where("cid <> center").groupBy("cid", "center").agg(F.count("*").alias("k"))
    proposed = votes.groupBy("cid").agg(F.max_by("center", F.struct("k", -F.col("center"))).alias("dst")).select(F.col("dst").alias("src"), F.col("cid").alias("dst"))
    links = materialize(confirm(proposed, sets, part, whole), "links")
    label = components(links).withColumnRenamed("node", "cid")
    labelled = members.select("band", "pos", "cid", "n").join(label, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    labelled = materialize(labelled, "labelled")
    discard(members)

    spread = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def across(dealt: DataFrame) -> DataFrame:
        full = dealt.join(sets.select("cid", "items"), "cid").select("band", "i", "j", "side", "cid", "label", "items")
        full = full.repartition(spread, "band", "i", "j").sortWithinPartitions("band", "i", "j", "cid")
        return materialize(full.mapInArrow(_block_links(part, whole), "src long, dst long"), "links")

    dealt, rest = _dealt(labelled, block, False)
    links = links.union(across(dealt))
    rest = materialize(rest, "rest")
    if not rest.isEmpty():
        again = materialize(_banded_again(rest, first.select(F.col("rid").alias("cid"), "sig"), permutations, rows), "again")
        links = links.union(across(_dealt(again, block, True)[0]))
    label = components(links).withColumnRenamed("node", "cid")

    joined = materialize(classes.join(label, "cid", "left"), "named")
    smallest = materialize(joined.where("label is not null").groupBy("label").agg(F.min("low_id").alias("component_id")), "smallest")
    named = joined.where("label is not null").join(smallest, "label").select("h1", "h2", "n", "component_id")
    named = named.union(joined.where("label is null").select("h1", "h2", "n", F.col("low_id").alias("component_id")))
    out = rowsets.where("n > 0").select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2", "n"]).select("doc_id", "n", "component_id")
    out = out.union(rowsets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op6_minmax_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=2)


#: An exact join of the shingle sets, then the smallest id that links reach.
ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s
  FROM words
),
sized AS (SELECT doc_id, len(s) AS n, s FROM sets),
shingles AS (SELECT doc_id, n, unnest(s) AS x FROM sized),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
reach AS (
  SELECT doc_id AS u, doc_id AS v FROM sized
  UNION
  SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v
)
SELECT z.doc_id, CAST(z.n AS BIGINT) AS n_shingles, min(r.v) AS component_id, min(r.v) = z.doc_id AS kept
FROM sized z JOIN reach r ON r.u = z.doc_id GROUP BY z.doc_id, z.n
"""
