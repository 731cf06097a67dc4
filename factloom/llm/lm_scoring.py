"""Language-model scores of whole texts beside a word-count base.

Words are lower-cased (A-Z).  The model reads each as the byte-level BPE ids of
the word with a space in front, then one end.  Its ids are the most frequent BPE
ids of the training texts and 256 bytes that spell all others, so every text has
a probability.  A task encodes a distinct word once and looks it up by its
64-bit hash from then on.

One pass over the whole training part writes the texts' ids, and partial counts
of words (64-bit hashes) and of ids.  From the written ids come the counts of
all pairs of neighbouring model ids.  The attention's output starts from the
smoothed pair counts, so it has to learn only what the ids further back add.

The attention learns from every window of the training part.  It starts from
weights that the driver fits on about ``attention_windows`` windows, drawn by a
hash.  Then each task descends from that start over all windows of its texts,
each window once, and the model is the mean of what the tasks arrive at, by
their windows; so it follows in part how texts are dealt to tasks.  While a
window is learned from, each of its pairs is left out of its own count.
Counts of the most frequent words (at most ``HEAVY``) go to every task; the
rest of a text's words meet their counts in a join, where no key has more rows
than the count at which ``HEAVY`` cuts.

Null and empty texts are an end alone.  A null id is hashed as null and is
never held out.  Repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attention import CONTEXT, IDS, SPAN, STRIDE, AttentionModel, Descent, PairOffsets, keep_memory, windows
from .kernel import _LOWER, mix, text_words
from .storage import discard, materialize
from .subwords import default_ranks, encode, encoder
from .supervised import fold

END = np.uint64(0xE4D)
HEAVY = 1 << 18


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes in order, where each comes first, the distinct one of each)."""
    code, found = pd.factorize(hashes)
    first = np.empty(len(found), np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    order = np.argsort(found)
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(len(found))
    return found[order], first[order], rank[code]


#: White space beyond ASCII, which the split pattern joins to a space behind it.
WIDE_SPACES = tuple(c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_WIDE_THEN_SPACE = re.compile(b"(?:" + b"|".join(WIDE_SPACES) + b")(?= )")


class WordIds:
    """BPE ids of words, each encoded once while it stays in a table of at most ``most`` words."""

    def __init__(self, ranks_path: str, most: int = 1 << 19):
        own = encoder(ranks_path)
        self.path, self.most = ranks_path, most
        self.size = np.array([len(own.decode_single_token_bytes(i)) for i in range(own.n_vocab)])
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _add(self, hashes: np.ndarray, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        low = _LOWER[raw].tobytes() if len(starts) > 64 else None
        words = [low[a : a + n] if low else _LOWER[raw[a : a + n]].tobytes() for a, n in zip(starts.tolist(), lengths.tolist())]
        ids = np.concatenate([encode(part.decode(), self.path) for part in self._lines(words)])
        word = np.searchsorted(np.cumsum(lengths + 1), np.cumsum(self.size[ids]), "left")
        count = np.bincount(word, minlength=len(words))
        where = np.searchsorted(self.known, hashes)
        self.at = np.insert(self.at, where, np.cumsum(count) - count + len(self.flat))
        self.count = np.insert(self.count, where, count)
        self.known = np.insert(self.known, where, hashes)
        self.flat = np.append(self.flat, ids.astype(np.int32))

    @staticmethod
    def _lines(words: list[bytes]):
        """The words, a space in front of each, as one text; apart where white space beyond ASCII would meet the next space."""
        line, at = b" " + b" ".join(words), 0
        for meet in _WIDE_THEN_SPACE.finditer(line):
            yield line[at : meet.end()]
            at = meet.end()
        yield line[at:]

    def ids(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, found: np.ndarray, first: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of words one after another, how many each word has) of the words of ``distinct`` hashes ``found``."""
        if len(self.known) > self.most:
            self._clear()
        at = np.searchsorted(self.known, found)
        new = self.known[np.minimum(at, len(self.known) - 1)] != found if len(self.known) else np.ones(len(found), bool)
        if new.any():
            self._add(found[new], raw, starts[first[new]], lengths[first[new]])
            at = np.searchsorted(self.known, found)
        count = self.count[at][code]
        edge = np.cumsum(count) - count
        return self.flat[np.repeat(self.at[at][code] - edge, count) + np.arange(int(count.sum()))], count


class Vocabulary:
    """Model ids: 0 end, 1 to 256 bytes, then the most frequent BPE ids; 16-bit tables."""

    def __init__(self, counts: dict[int, int], ranks_path: str):
        own = encoder(ranks_path)
        self.path = ranks_path
        common = sorted(counts, key=lambda i: (-counts[i], i))[: IDS - 257]
        single = np.zeros(own.n_vocab, np.int64)
        single[common] = np.arange(len(common)) + 257
        spelt = [[int(single[i])] if single[i] else [1 + b for b in own.decode_single_token_bytes(i)] for i in range(own.n_vocab)]
        self.length = np.array([len(x) for x in spelt], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.flat = np.array([x for s in spelt for x in s], np.int64)
        total = np.zeros(IDS)
        for i, n in counts.items():
            np.add.at(total, spelt[i], n)
        # by frequency, so that a class of the output holds ids of like frequency
        self.rank = np.empty(IDS, np.int64)
        order = np.lexsort((np.arange(1, IDS), -total[1:])) + 1
        self.rank[np.r_[0, order]] = np.arange(IDS)
        self.counts = np.empty(IDS)
        self.counts[self.rank] = total

    def ids(self, bpe: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(model ids of texts one after another, each with its end; how many each has) of BPE ids that end at ``ends``."""
        length = self.length[bpe]
        total = np.r_[0, np.cumsum(length)]
        if total[-1] == len(bpe):
            found = self.flat[self.at[bpe]]
        else:
            found = self.flat[np.repeat(self.at[bpe] - total[:-1], length) + np.arange(total[-1])]
        ends = total[ends]
        return self.rank[np.insert(found, ends, 0)], np.diff(np.r_[0, ends]) + 1


TEXT, WORD, ID = 0, 1, 2


def encoded(train: DataFrame, ranks_path: str) -> DataFrame:
    """Of ``train`` (text): its texts' BPE ids (kind TEXT: ids, n of them), and partial counts (k, n) of words and of ids."""

    def run(batches):
        words = WordIds(ranks_path)
        small = "<u2" if len(words.size) <= 1 << 16 else "<u4"
        total = np.zeros(len(words.size), np.int64)
        keys, sums, held = [], [], 0

        def counts(kind, key, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.nulls(len(key), pa.binary()), pa.array(key), pa.array(n)], ["kind", "ids", "k", "n"])

        def flush():
            u, back = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(back, np.concatenate(sums)).astype(np.int64)
            for at in range(0, len(u), 1 << 16):
                yield counts(WORD, u[at : at + (1 << 16)].view(np.int64), n[at : at + (1 << 16)])

        for batch in batches:
            for _, sizes, raw, starts, lengths, hashes in text_words(batch.column(0)):
                found, first, code = distinct(hashes)
                ids, count = words.ids(raw, starts, lengths, found, first, code)
                total += np.bincount(ids, minlength=len(total))
                keys += [found, np.array([END])]
                sums += [np.bincount(code, minlength=len(found)), np.array([len(sizes)])]
                held += len(found)
                cut = np.r_[0, np.cumsum(count)][np.r_[0, np.cumsum(sizes)]]
                raw_ids, width = ids.astype(small).tobytes(), int(small[-1])
                texts = [raw_ids[a * width : z * width] for a, z in zip(cut[:-1].tolist(), cut[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), TEXT, np.int8)), pa.array(texts, pa.binary()), pa.nulls(len(sizes), pa.int64()), pa.array(np.diff(cut))], ["kind", "ids", "k", "n"])
                if held > 2_000_000:
                    yield from flush()
                    keys, sums, held = [], [], 0
        if keys:
            yield from flush()
        at = np.flatnonzero(total)
        yield counts(ID, at, total[at])

    return train.mapInArrow(run, "kind byte, ids binary, k long, n long")


def _model_ids(column: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    small = "<u2" if len(vocabulary.length) <= 1 << 16 else "<u4"
    rows = column.to_pylist()
    bpe = np.frombuffer(b"".join(rows), small).astype(np.int64)
    return vocabulary.ids(bpe, np.cumsum([len(x) for x in rows], dtype=np.int64) // int(small[-1]))


def pair_counts(texts: DataFrame, shipped) -> DataFrame:
    """(pair, n) sums of each task over ``texts`` (ids): model ids beside the id before them, as before * IDS + id."""

    def run(batches):
        vocabulary, held, size = shipped.value, [], 0
        total = np.zeros(IDS * IDS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids, _ = _model_ids(batch.column(0).slice(at, 512), vocabulary)
                held.append(np.r_[0, ids[:-1]] * IDS + ids)  # a text begins behind the end of another
                size += len(ids)
                if size > 1 << 22:
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        found = np.flatnonzero(total)
        for at in range(0, len(found), 1 << 16):
            part = found[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part], pa.int64())], ["pair", "n"])

    return texts.mapInArrow(run, "pair long, n long")


class PairMixture:
    """Weights of the attention output and of smoothed pair counts, by the size of the count of the id before.

    For models without ``PairOffsets``; ``score_texts`` has no need of it.
    """

    SMOOTH = 8.0
    SIZES = 64
    #: Steps of the ratio of two probabilities, and how many make one natural logarithm.
    STEPS, FINE = 256, 8

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, frequencies: np.ndarray):
        table = np.zeros(IDS * IDS, np.float32)
        table[pairs] = counts
        table = table.reshape(IDS, IDS)
        self.before = table.sum(1, dtype=np.float64)
        self.size = np.floor(np.log2(self.before + 1)).astype(int)
        self.base = (frequencies + 0.5) / (frequencies + 0.5).sum()
        self.table = table
        self.weight = np.full(self.SIZES, 0.5)

    def seen(self, keys: np.ndarray, targets: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Counts of targets by the size of the id before and by how much likelier pairs made them than ``own``, the attention's log probabilities.

        The windows are among the counts: each target is left out of its own count.
        """
        live = targets.ravel() >= 0
        before, goal = keys[:, CONTEXT:].ravel()[live], targets.ravel()[live]
        n = np.maximum(self.table.ravel()[before * IDS + goal] - 1, 0)
        pair = (n + self.SMOOTH * self.base[goal]) / (np.maximum(self.before[before] - 1, 0) + self.SMOOTH)
        ratio = (np.log(pair) - own.ravel()[live]) * self.FINE + self.STEPS / 2
        return np.bincount(self.size[before] * self.STEPS + np.clip(np.rint(ratio), 0, self.STEPS - 1).astype(np.int64), minlength=self.SIZES * self.STEPS)

    def fit(self, seen: np.ndarray, rounds: int = 20) -> None:
        """EM for the weights on sums of ``seen``."""
        seen, ratio = seen.reshape(self.SIZES, self.STEPS), np.exp((np.arange(self.STEPS) - self.STEPS / 2) / self.FINE)
        for _ in range(rounds):
            w = self.weight[:, None] * ratio
            taken = seen * (w / (w + 1 - self.weight[:, None]))
            self.weight = (taken.sum(1) + 0.5) / (seen.sum(1) + 1)  # sizes never met keep one half

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """(weight of the attention by id before, weighted pair probabilities); both float32."""
        w = self.weight[self.size]
        out = self.table
        out += (self.SMOOTH * self.base).astype(np.float32)
        out *= (w / (self.before + self.SMOOTH)).astype(np.float32)[:, None]
        self.table = None
        return (1 - w).astype(np.float32), out.astype(np.float32).ravel()


def mixed_log_probs(model: AttentionModel, keys: np.ndarray, targets: np.ndarray, tables, mixture) -> np.ndarray:
    """Natural log probability of each target under the mixture; 0 beyond a text."""
    own = model.log_probs(keys, targets, tables)
    if mixture is None:
        return own
    keep, pair = mixture
    before, live = keys[:, CONTEXT:], targets >= 0
    at = np.where(live, before.astype(np.int64) * IDS + targets, 0)
    return np.where(live, np.log(keep[np.where(live, before, 0)] * np.exp(own) + pair[at]), np.float32(0))


def _drawn(rows: pa.Array, share: float):
    """Whether a window, by its text's place in ``rows`` (ids) and its own place in the text, is of the share that is drawn."""
    least = np.uint64(min(share, 1.0) * (2**64 - 2**11))
    own = mix(np.array([zlib.crc32(x) for x in rows.to_pylist()], np.uint64))
    return lambda text, block: mix(own[text] + mix(block.astype(np.uint64) + np.uint64(8))) <= least


def sample_windows(texts: DataFrame, shipped, share: float) -> tuple[np.ndarray, np.ndarray]:
    """A share of all windows of ``texts`` (ids), drawn by a hash of a text's ids and the window's place."""

    def run(batches):
        vocabulary = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.column(0).slice(at, 512)
                ids, counts = _model_ids(rows, vocabulary)
                keys, targets, text = windows(ids, counts, _drawn(rows, share))
                if len(text):
                    yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i2").tobytes()], pa.binary()) for x in (keys, targets)], ["k", "t"])

    rows = texts.mapInArrow(run, "k binary, t binary").toArrow()  # about the windows asked for, whatever the input
    keys, targets = (np.frombuffer(b"".join(rows.column(c).to_pylist()), "<i2") for c in ("k", "t"))
    keys, targets = keys.reshape(-1, SPAN), targets.reshape(-1, STRIDE)
    order = np.lexsort((*targets.T, *keys.T))  # the same order whatever the tasks
    return keys[order], targets[order]


def all_windows(batches, vocabulary: Vocabulary, share: float, most: int = 1 << 14):
    """(keys, targets, whether drawn by ``share``) of every window of the texts (ids), at most ``most`` at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            rows = batch.column(0).slice(at, 512)
            ids, counts = _model_ids(rows, vocabulary)
            drawn, edge = _drawn(rows, share), np.r_[0, np.cumsum(counts)]
            blocks = np.cumsum((counts + STRIDE - 1) // STRIDE)
            first = 0
            while first < len(counts):
                done = blocks[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(blocks, done + most, "right")))
                for begin in range(0, int(blocks[last - 1] - done), most):  # more than one range only where one text has more windows
                    picked = []

                    def pick(text, block, first=first, begin=begin, picked=picked):
                        place = np.arange(len(text))
                        own = (place >= begin) & (place < begin + most)
                        picked.append(drawn(text[own] + first, block[own]))
                        return own

                    keys, targets, _ = windows(ids[edge[first] : edge[last]], counts[first:last], pick)
                    yield keys.astype(np.int16), targets.astype(np.int16), picked[0]
                first = last


def descend(texts: DataFrame, shipped, counted, share: float, batch: int, expected: float, rate: float = 4e-2, pool: int = 1 << 14) -> np.ndarray | None:
    """Mean of the parameters that the tasks arrive at over all windows of ``texts`` (ids); None without one.

    A task learns from each of its windows once, mixed in pools of about ``pool`` windows, at a rate that falls over
    about ``expected`` windows.  Models are written, a row a task, and summed by about as many tasks as each sums rows.
    """

    def run(batches):
        keep_memory()
        start, vocabulary = shipped.value
        model, draw = start.over(counted.value), np.random.default_rng(TaskContext.get().partitionId())
        descent, done = Descent(model), 0

        def learn(held, rest):
            nonlocal done
            keys, targets = (np.concatenate(x) for x in zip(*held))
            order = draw.permutation(len(keys))
            cut = len(order) - len(order) % batch if rest else len(order)
            for at in range(0, cut, batch):
                own = order[at : min(at + batch, cut)]
                _, g = model.learn(keys[own].astype(np.int64), targets[own].astype(np.int64))
                done += len(own)
                descent.step(g, rate * min(1.0, (descent.steps + 1) / 20) * max(0.03, 1 - done / expected))
            left = order[cut:]
            return [(keys[left], targets[left])], len(left)

        held, size = [], 0
        for keys, targets, _ in all_windows(batches, vocabulary, share):
            held.append((keys, targets))
            size += len(keys)
            if size >= pool:
                held, size = learn(held, True)
        if size:
            learn(held, False)
        if done:
            yield row(done, descent.all.astype(np.float64) * done)

    def row(n, total):
        return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["n", "model"])

    def added(batches):
        n, total = 0, 0
        for b in batches:
            for k, x in zip(*(c.to_pylist() for c in b.columns)):
                n, total = n + k, total + np.frombuffer(x)
        if n:
            yield row(n, total)

    kind = "n long, model binary"
    models = materialize(texts.mapInArrow(run, kind), "models")
    tasks = models.count()
    sums = list(added(models.coalesce(math.isqrt(tasks) + 1).mapInArrow(added, kind).toArrow().to_batches()))
    discard(models)
    if not sums:
        return None
    n, total = (c.to_pylist()[0] for c in sums[0].columns)
    return np.frombuffer(total) / n


def _score_texts(model: AttentionModel, tables, ids: list[np.ndarray], batch: int = 128, mixture=None) -> np.ndarray:
    """log10 probability of each text, in batches of windows that may hold several texts."""
    out = np.zeros(len(ids))
    start = 0
    while start < len(ids):
        stop, size = start, 0
        while stop < len(ids) and (stop == start or size + len(ids[stop]) <= 1 << 17):
            size += len(ids[stop])
            stop += 1
        counts = np.array([len(x) for x in ids[start:stop]])
        if stop - start == 1 and size > 1 << 17:  # one long text: piece by piece, with the ids before it as context
            text, step = ids[start], 1 << 16
            for at in range(0, len(text), step):
                back = at - step // 16 * 8 if at else 0
                keys, targets, _ = windows(text[back : at + step], np.array([min(len(text), at + step) - back]))
                skip = (at - back) // targets.shape[1]
                for k in range(skip, len(keys), batch):
                    out[start] += mixed_log_probs(model, keys[k : k + batch], targets[k : k + batch], tables, mixture).sum(dtype=np.float64)
        else:
            keys, targets, text = windows(np.concatenate(ids[start:stop]), counts)
            for k in range(0, len(keys), batch):
                got = mixed_log_probs(model, keys[k : k + batch], targets[k : k + batch], tables, mixture).sum(1, dtype=np.float64)
                np.add.at(out, start + text[k : k + batch], got)
        start = stop
    return out / math.log(10)


def _score_once(model: AttentionModel, tables, ids: list[np.ndarray], mixture, seen: dict[bytes, float], most: int = 1 << 16) -> np.ndarray:
    """``_score_texts``, texts with the same ids once a task while they are among the last ``most`` or so."""
    keys = [blake2b(x.astype("<i2").tobytes(), digest_size=16).digest() for x in ids]
    if len(seen) > most:
        seen.clear()
    new = {k: x for k, x in zip(keys, ids) if k not in seen}
    seen.update(zip(new, _score_texts(model, tables, list(new.values()), mixture=mixture).tolist()))
    return np.array([seen[k] for k in keys])


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", attention_windows: int = 1 << 17, steps: int = 1500, batch: int = 64, ranks_path: str | None = None, whole: bool = True) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); ``held_out`` is a condition on ``doc_id``.

    Without ``whole`` the model stays at its start, for callers that do not keep ``score``.
    """
    path, spark = ranks_path or default_ranks(), docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    train = materialize(encoded(rows.where(~F.col("held_out")).select("text"), path), "encoded")
    texts = train.where(F.col("kind") == TEXT).select("ids")
    counts = materialize(train.where(F.col("kind") == WORD).groupBy(F.col("k").alias("h")).agg(F.sum("n").alias("c")), "words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    steps_down = sorted(((r["b"], r["k"]) for r in counts.groupBy(F.floor(F.log2("c")).cast("int").alias("b")).agg(F.count("*").alias("k")).collect()), reverse=True)
    held, least = 0, 63
    for b, k in steps_down:  # the lowest power of two above which at most HEAVY words lie
        if held + k > HEAVY:
            break
        held, least = held + k, b
    end = int(END)
    heavy = counts.where((F.col("c") >= F.lit(2**least if least < 63 else 2**62)) | (F.col("h") == end)).select("h", "c").toArrow()  # at most HEAVY + 1 rows
    heavy_h = heavy.column("h").to_numpy().view(np.uint64)
    order = np.argsort(heavy_h)
    table = spark.sparkContext.broadcast((heavy_h[order], heavy.column("c").to_numpy().astype(np.float64)[order]))

    ends = counts.where(F.col("h") == end).first()
    sums = {r["k"]: r["n"] for r in train.where(F.col("kind") == ID).groupBy("k").agg(F.sum("n").alias("n")).collect()}  # at most one row a BPE id
    vocabulary = Vocabulary(sums, path)
    coder = spark.sparkContext.broadcast(vocabulary)
    pairs = pair_counts(texts, coder).groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most IDS * IDS rows
    offsets = PairOffsets(pairs.column("pair").to_numpy(), pairs.column("n").to_numpy(), vocabulary.counts)
    del pairs
    counted = spark.sparkContext.broadcast(offsets)
    there = sum(sums.values()) / STRIDE + (ends["c"] if ends else 0)  # windows in the training part, or a few less
    share = min(attention_windows / max(1, there), 0.9)
    keys, targets = sample_windows(texts, coder, share)
    model = AttentionModel(vocabulary.counts, offsets)
    if len(keys):
        model.train(keys, targets, steps, batch)
    model = model.over(None)
    del keys, targets
    tasks = max(1, min(int(there) >> 14, texts.rdd.getNumPartitions()))  # a task has windows enough to learn from
    start = spark.sparkContext.broadcast((model, vocabulary))
    found = descend(texts.coalesce(tasks), start, counted, share, 4 * batch, there / tasks) if whole else None
    discard(train)
    start.unpersist()
    if found is not None:
        model.take(found)
    shipped = spark.sparkContext.broadcast((model, vocabulary))

    def run(batches):
        keep_memory()
        model, vocabulary = shipped.value
        model = model.over(counted.value)
        heavy_h, heavy_c = table.value
        value, tables, task, count = np.log10(heavy_c + 0.5), model.tables(), TaskContext.get().partitionId(), 0
        words, seen = WordIds(path), {}
        for batch_ in batches:
            for row, sizes, raw, starts, lengths, hashes in text_words(batch_.column(1)):
                k = len(sizes)
                found, first, code = distinct(hashes)
                at = np.minimum(np.searchsorted(heavy_h, found), max(len(heavy_h) - 1, 0))
                known = heavy_h[at] == found if len(heavy_h) else np.zeros(len(found), bool)
                own = np.where(known, value[at], 0) if len(heavy_h) else np.zeros(len(found))
                text, known = np.repeat(np.arange(k), sizes), known[code]
                n_known = np.bincount(text[known], minlength=k)
                base = np.bincount(text, own[code], minlength=k)
                cut = np.r_[0, np.cumsum(np.bincount(text[~known], minlength=k))].astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(hashes.view(np.int64)[~known], pa.int64()))
                bpe, per = words.ids(raw, starts, lengths, found, first, code)
                ids, size = vocabulary.ids(bpe, np.r_[0, np.cumsum(per)][np.cumsum(sizes)])
                score = _score_once(model, tables, np.split(ids, np.cumsum(size)[:-1]), None, seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(count, count + k) + (task << 33)), batch_.column(0).slice(row, k), batch_.column(2).slice(row, k), pa.array(sizes.astype(np.int64) + 1), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(score), rare],
                    ["rid", "doc_id", "held_out", "n_tokens", "k", "s", "score", "rare"],
                )
                count += k

    scored = materialize(rows.select("doc_id", "text", "held_out").mapInArrow(run, "rid long, doc_id long, held_out boolean, n_tokens long, k long, s double, score double, rare array<long>"), "scored")
    rare = scored.select("rid", F.explode("rare").alias("h")).join(counts, "h", "left").groupBy("rid").agg(F.count("c").alias("k2"), F.sum(F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5)).alias("s2"))
    whole = math.log10(n + 0.5 * (v + 1))
    last = math.log10((ends["c"] if ends else 0) + 0.5)
    return scored.join(rare, "rid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("k") + F.coalesce("k2", F.lit(0)) + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("s") + F.coalesce("s2", F.lit(0.0)) + last - F.col("n_tokens") * whole).alias("base_score"),
        "score",
    )


def op8_attention_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold("doc_id", 5) == 1)
