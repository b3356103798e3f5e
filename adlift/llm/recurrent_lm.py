"""Document scores from a gated recurrent language model.

Counts of all training words (one grouped sum over the whole corpus) give the
base model, the vocabulary and the static parts. The most frequent ``HEAD``
words are symbols of their own, in classes of like total frequency; every other
word is one of ``TAIL`` classes, by its last byte. The network (a gated
recurrent unit in numpy) predicts the next word's class and, inside a head
class, the word; inside a tail class words follow absolutely discounted counts,
whose discount is the share of unseen words. It is fitted by truncated
backpropagation on all training documents. Their symbols, two bytes each in
parts of at most ``PART``, are dealt to shards of about ``SHARD`` tokens by a hash
of the row; every round passes over each shard from the same weights, which are
averaged by tokens with a grouped sum. Shards and the order in them follow from
the rows alone, so the model does not depend on how the table is partitioned.

Scoring runs whole documents in lanes, window by window, and carries the state
across windows, so the score is that of the complete text. Counts of up to
``DICT`` words are broadcast; rarer words shuffle once to meet their counts, so
no table that grows with the corpus is collected.

Defined results: null text is empty, one end token. Rows are scored one by one,
so repeated rows and null ids keep their rows; a null id counts as training
(its crc32 is null). With no training rows every word is unseen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlift.llm.common import small_batches, written

HEAD = 2000
TAIL = 16
HIDDEN = 16
WINDOW = 32
LANES = 512
ROUNDS = 1
ROWS = 512               # states whose class softmax is computed at once
DICT = 200_000
SHARD = 1 << 22          # tokens of a shard, on average
PART = 4096              # most symbols of a document in one part
GROUP = 1 << 21          # least tokens scored together, but for a task's last
TASKS = 8192             # most tasks of a round; shards beyond follow each other in a task
END = b""                # the end token; no word is empty


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def tail_class(word: bytes) -> int:
    return word[-1] % TAIL if word else 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            seen.update(_words(text))
            seen[END] += 1
            if len(seen) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], schema=schema)
                seen = Counter()
    yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], schema=schema)


class Shape:
    """Symbols and classes: head words by falling count, then the tail classes."""

    def __init__(self, head: list[tuple[bytes, int]]):
        self.counts = head
        self.head = {w: i for i, (w, _) in enumerate(head)}
        root = np.sqrt([n for _, n in head]) if head else np.empty(0)
        groups = max(1, int(0.6 * len(head) ** 0.5))
        self.word_class = np.minimum((np.cumsum(root) / max(root.sum(), 1e-9) * groups).astype(int), groups - 1)
        self.word_class = np.unique(self.word_class, return_inverse=True)[1].ravel()
        self.classes = int(self.word_class.max()) + 1 if len(head) else 0
        self.first = np.searchsorted(self.word_class, np.arange(self.classes + 1))
        v, c, h = len(head) + TAIL, self.classes + TAIL, HIDDEN
        self.parts = {"emb": (v, h), "wx": (h, 3 * h), "wh": (h, 3 * h), "b": (3 * h,),
                      "wc": (h, c), "bc": (c,), "wo": (len(head), h), "bo": (len(head),)}
        self.size = sum(int(np.prod(s)) for s in self.parts.values())

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, s in self.parts.items():
            n = int(np.prod(s))
            out[k] = flat[at:at + n].reshape(s)
            at += n
        return out

    def start(self, head: list[tuple[bytes, int]], tail: np.ndarray) -> np.ndarray:
        """Small random weights; biases are the log frequencies."""
        flat = np.random.default_rng(1).normal(scale=0.1, size=self.size).astype(np.float32)
        p = self.split(flat)
        n = np.array([c for _, c in head], dtype=np.float64)
        mass = np.concatenate((np.bincount(self.word_class, n, self.classes) if len(head) else [], tail)) + 1
        p["bc"][:] = np.log(mass / mass.sum())
        p["bo"][:] = np.log(n + 1) if len(head) else 0
        p["b"][:] = 0
        return flat

    def code(self, words: list[bytes]) -> np.ndarray:
        head, get, v = self.head, self.head.get, len(self.head)
        return np.array([get(w, -1) if w in head else v + tail_class(w) for w in words], dtype=np.int64)

    def symbol_class(self, symbols: np.ndarray) -> np.ndarray:
        v = len(self.head)
        if not v:
            return symbols
        return np.where(symbols < v, self.word_class[np.minimum(symbols, v - 1)], symbols - v + self.classes)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.exp(np.minimum(-x, np.float32(80)))
    x += 1
    return np.reciprocal(x, out=x)


def _step(xw: np.ndarray, h: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(new state, gates z and r, candidate, its recurrent share) of one step of all lanes, a lane per column, so that each
    gate is one stretch of memory; xw: the input's share of the three sums, wh: the recurrent weights, transposed."""
    n = len(h)
    hw = wh @ h
    zr = _sigmoid(xw[:2 * n] + hw[:2 * n])
    z, r, hc = zr[:n], zr[n:], hw[2 * n:]
    c = _sigmoid(2 * (xw[2 * n:] + r * hc))       # tanh, by the faster exponential
    c *= 2
    c -= 1
    return c + z * (h - c), zr, c, hc


def _cell(xw: np.ndarray, h: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, ...]:
    """``_step`` with a lane per row."""
    return tuple(x.T for x in _step(xw.T, h.T, wh.T))


def _log_softmax_at(x: np.ndarray, at: np.ndarray, share: float | None) -> np.ndarray:
    """Log softmax of row ``at`` of each column (long columns keep the sums in vector registers). With ``share``, x becomes
    the gradient of -share times their sum."""
    columns = np.arange(len(at))
    x -= x.max(axis=0)
    out = x[at, columns]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    if share is not None:
        x *= share / total
        x[at, columns] -= share
    return out - np.log(total)


def log_probabilities(shape: Shape, p: dict[str, np.ndarray], h: np.ndarray, target: np.ndarray,
                      grad: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log probability of each target symbol given its state; with ``grad``, adds the output gradients of
    the mean loss there and returns the states' gradient."""
    kind = shape.symbol_class(target)
    order = np.argsort(kind.astype(np.int16), kind="stable")
    kind, goal, states = kind[order], target[order], h[order]
    bounds = np.searchsorted(kind, np.arange(shape.classes + 1))
    share = np.float32(1 / max(len(target), 1)) if grad is not None else None
    value, dh = np.empty(len(target), np.float32), np.empty_like(states) if grad is not None else None
    for i in range(0, len(target), ROWS):         # as much as the cache holds
        mine = states[i:i + ROWS]
        d = p["wc"].T @ mine.T
        d += p["bc"][:, None]
        value[i:i + ROWS] = _log_softmax_at(d, kind[i:i + ROWS], share)
        if grad is not None:
            grad["wc"] += (d @ mine).T
            grad["bc"] += d.sum(axis=1)
            dh[i:i + ROWS] = (p["wc"] @ d).T
    for c in range(shape.classes):
        i, j = bounds[c], bounds[c + 1]
        if i == j:
            continue
        lo, hi = shape.first[c], shape.first[c + 1]
        if hi == lo + 1:
            continue                              # the class is its only word
        mine, weights = states[i:j], p["wo"][lo:hi]
        d = weights @ mine.T
        d += p["bo"][lo:hi, None]
        value[i:j] += _log_softmax_at(d, goal[i:j] - lo, share)
        if grad is not None:
            grad["wo"][lo:hi] += d @ mine
            grad["bo"][lo:hi] += d.sum(axis=1)
            dh[i:j] += (weights.T @ d).T
    out = np.empty(len(target))
    out[order] = value
    if grad is not None:
        back = np.empty_like(dh)
        back[order] = dh
        dh = back
    return out, dh


def train(shape: Shape, flat: np.ndarray, docs: list[np.ndarray], before: list[int] | None = None, rate: float = 0.03) -> np.ndarray:
    """One pass of truncated backpropagation (Adam) over documents, or parts that follow the symbols ``before``. They
    stand one after the other in lanes of equal length; states start anew with each of them."""
    end = shape.head.get(END, len(shape.head))
    stream = np.concatenate(docs).astype(np.int16) if docs else np.empty(0, np.int16)
    lanes = int(np.clip(len(stream) // (64 * WINDOW), 8, LANES))      # small shards: fewer lanes, not fewer steps
    steps = -(-len(stream) // lanes)
    first = np.cumsum([0] + [len(d) for d in docs])[:-1]
    target = np.full(lanes * steps, -1, dtype=np.int16)
    target[:len(stream)] = stream
    source = np.maximum(np.concatenate((np.array([end], np.int16), target[:-1])), 0)[:lanes * steps]
    fresh = np.zeros(lanes * steps, dtype=bool)
    fresh[first], source[first] = True, end if before is None else before
    # a row per step
    target, source, fresh = (np.ascontiguousarray(x.reshape(lanes, steps).T) for x in (target, source, fresh))
    flat = flat.copy()
    p, m, v = shape.split(flat), np.zeros_like(flat), np.zeros_like(flat)
    h, k = np.zeros((HIDDEN, lanes), dtype=np.float32), HIDDEN
    for step, t0 in enumerate(range(0, steps, WINDOW), 1):
        g = np.zeros_like(flat)
        grad = shape.split(g)
        src, n = source[t0:t0 + WINDOW].astype(np.int64), min(steps - t0, WINDOW)
        go_on = (~fresh[t0:t0 + WINDOW]).astype(np.float32)
        table, wh = np.ascontiguousarray((p["emb"] @ p["wx"] + p["b"]).T), np.ascontiguousarray(p["wh"].T)
        kept, states = [], np.empty((n, HIDDEN, lanes), dtype=np.float32)
        for t in range(n):
            start = h * go_on[t]
            h, zr, c, hc = _step(table.take(src[t], axis=1), start, wh)
            kept.append((start, zr, c, hc))
            states[t] = h
        goal = target[t0:t0 + WINDOW].ravel().astype(np.int64)
        mask = goal >= 0
        states = states.transpose(0, 2, 1).reshape(-1, HIDDEN)
        dstate = np.zeros_like(states)
        _, dstate[mask] = log_probabilities(shape, p, states[mask], goal[mask], grad)
        dstate = np.ascontiguousarray(dstate.reshape(n, lanes, HIDDEN).transpose(0, 2, 1))
        dh = np.zeros_like(h)
        dx, back = np.empty((n, 3 * k, lanes), np.float32), np.empty((3 * k, lanes), np.float32)
        for i in range(n - 1, -1, -1):
            start, zr, c, hc = kept[i]
            z, d = zr[:k], dx[i]
            dh += dstate[i]
            dc = dh * (1 - z) * (1 - c * c)
            d[:k] = dh * (start - c)
            d[k:2 * k] = dc * hc
            d[:2 * k] *= zr * (1 - zr)
            d[2 * k:] = dc
            back[:2 * k] = d[:2 * k]
            back[2 * k:] = dc * zr[k:]
            grad["wh"] += start @ back.T
            dh = (dh * z + p["wh"] @ back) * go_on[i]
        dx, src = dx.transpose(0, 2, 1).reshape(-1, 3 * k), src.ravel()
        grad["wx"] += p["emb"][src].T @ dx
        grad["b"] += dx.sum(axis=0)
        order = np.argsort(src.astype(np.int16), kind="stable")
        at = np.flatnonzero(np.diff(src[order], prepend=-1))
        grad["emb"][src[order][at]] += np.add.reduceat((dx @ p["wx"].T)[order], at, axis=0)
        g *= np.float32(min(1.0, 5.0 / max(float(np.linalg.norm(g)), 1e-9)))
        m += np.float32(0.1) * (g - m)
        v += np.float32(0.001) * (g * g - v)
        flat -= np.float32(rate / (1 - 0.9 ** step)) * m / (np.sqrt(v * np.float32(1 / (1 - 0.999 ** step))) + np.float32(1e-8))
    return flat


def train_round(learn: DataFrame, shape: Shape, flat: np.ndarray, shard: int = SHARD, tokens: int | None = None) -> DataFrame:
    """(k, w, n): weight k after a pass over every row of ``learn``, averaged over shards by their n tokens.

    ``tokens``: tokens of ``learn``, where they have been counted already. A row's shard follows from a hash of all
    its columns, so copies under several ids spread; of rows alike in every column a task holds two shards' tokens at most.
    """
    head, size = shape.counts, shape.size
    at = learn.sparkSession.sparkContext.broadcast((head, flat))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = Shape(at.value[0])
        end = shape.head.get(END, len(shape.head))
        for batch in batches:
            key, part, before, codes = [], [], [], []
            for k, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                symbols = shape.code(_words(text) + [END]).astype(np.int16)
                for i in range(0, len(symbols), PART):
                    key.append(k)
                    part.append(i // PART)
                    before.append(int(symbols[i - 1]) if i else end)
                    codes.append(symbols[i:i + PART].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(part, pa.int32()), pa.array(before, pa.int32()),
                                              pa.array(codes, pa.binary())], names=["key", "part", "before", "codes"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, flat = Shape(at.value[0]), at.value[1]
        total, tokens, held, now = np.zeros(size), 0, 0, None
        docs: list[np.ndarray] = []
        follows: list[int] = []

        def close() -> None:
            nonlocal tokens, held
            if held:
                total[:] += train(shape, flat, docs, follows).astype(np.float64) * held
            tokens += held
            docs.clear()
            follows.clear()
            held = 0

        for batch in batches:
            for b, before, codes in zip(*(batch.column(c).to_pylist() for c in ("shard", "before", "codes"))):
                if b != now or held >= 2 * shard:
                    close()
                    now = b
                docs.append(np.frombuffer(codes, np.int16))
                follows.append(before)
                held += len(docs[-1])
        close()
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total, pa.float64()),
                                              pa.array(np.full(size, tokens), pa.int64())], names=["k", "w", "n"])

    rows = learn.select(F.xxhash64(*learn.columns).alias("key"), "text")
    parts = rows.mapInArrow(cut, "key long, part int, before int, codes binary")
    if tokens is None:
        tokens = parts.agg(F.sum(F.octet_length("codes") / 2)).first()[0] or 0
    shards = max(1, -(-int(tokens) // shard))
    parts = parts.withColumn("shard", F.pmod(F.xxhash64("key", "part"), F.lit(shards)))
    parts = parts.repartition(min(shards, TASKS), "shard").sortWithinPartitions("shard", "key", "part", "codes", "before")
    sums = parts.select("shard", "before", "codes").mapInArrow(fit, "k int, w double, n long")
    return sums.groupBy("k").agg((F.sum("w") / F.sum("n")).alias("w"), F.sum("n").alias("n"))


def score(shape: Shape, p: dict[str, np.ndarray], docs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each whole symbol sequence; the state is carried from window to window."""
    end = shape.head.get(END, len(shape.head))
    total = np.zeros(len(docs))
    table, wh = np.ascontiguousarray((p["emb"] @ p["wx"] + p["b"]).T), np.ascontiguousarray(p["wh"].T)
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    length = np.array([len(docs[i]) for i in order])
    h = np.zeros((HIDDEN, len(docs)), dtype=np.float32)
    last = np.full(len(docs), end)
    for t0 in range(0, int(length[0]) if len(docs) else 0, WINDOW):
        k = int((length > t0).sum())
        target = np.full((k, WINDOW), -1, dtype=np.int64)
        for i in range(k):
            part = docs[order[i]][t0:t0 + WINDOW]
            target[i, :len(part)] = part
        source = np.ascontiguousarray(np.concatenate((last[:k, None], np.maximum(target[:, :-1], 0)), axis=1).T)
        h, states = h[:, :k], np.empty((WINDOW, HIDDEN, k), dtype=np.float32)
        for t in range(WINDOW):
            h = _step(table.take(source[t], axis=1), h, wh)[0]
            states[t] = h
        last = np.maximum(target[:, -1], 0)
        flat = target.T.ravel()
        mask = flat >= 0
        value, _ = log_probabilities(shape, p, states.transpose(0, 2, 1).reshape(-1, HIDDEN)[mask], flat[mask])
        total[:k] += np.bincount(np.tile(np.arange(k), WINDOW)[mask], value, k)
    out = np.empty(len(docs))
    out[order] = total
    return out


def score_documents(docs: DataFrame, training, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every row; ``training`` is a condition on doc_id (null: training).

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    docs = docs.select("doc_id", "text", F.coalesce(training, F.lit(True)).alias("learn"))
    learn = docs.where("learn").select("doc_id", "text")
    counts = learn.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    tail = F.when(F.octet_length("word") > 0, F.conv(F.hex(F.expr("substring(word, -1, 1)")), 16, 10).cast("int") % TAIL).otherwise(0)
    counts = written(counts.withColumn("grp", tail), "counts")

    sizes = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n"))
    size = counts.agg(F.sum("n"), F.count("*")).first()
    whole, distinct = size[0] or 0, size[1]
    bound = sizes.limit(DICT).collect()      # falling counts: after DICT of them the dictionary is full at least
    cut, room = 1 << 62, DICT
    for r in bound:
        if r.words > room:
            break
        cut, room = r.n, room - r.words
    known = {bytes(r.word): r.n for r in counts.where(F.col("n") >= cut).select("word", "n").collect()}
    head = sorted(known.items(), key=lambda x: (-x[1], x[0]))[:HEAD]
    in_head = dict(head)
    groups = {r.grp: r for r in counts.groupBy("grp").agg(
        F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("n1"),
        F.count_if(F.col("n") == 2).alias("n2")).collect()}
    stat = np.zeros((TAIL, 4))               # tokens, words, words seen once and twice outside the head
    for g, r in groups.items():
        stat[g] = r.n, r.v, r.n1, r.n2
    for w, n in in_head.items():
        stat[tail_class(w)] -= n, 1, n == 1, n == 2
    discount = np.clip(stat[:, 2] / np.maximum(stat[:, 2] + 2 * stat[:, 3], 1), 0.1, 0.9)
    seen = stat[:, 0] > 0
    unseen = np.where(seen, np.log10(np.maximum(discount * stat[:, 1] / np.maximum(stat[:, 0], 1), 1e-300)), 0.0)

    shape = Shape(head)
    flat = shape.start(head, stat[:, 0])
    if whole:
        for _ in range(ROUNDS):
            mean = train_round(learn, shape, flat, SHARD, int(whole)).toPandas()       # the model's size
            flat = flat.copy()
            flat[mean["k"].to_numpy()] = mean["w"].to_numpy()

    model = spark.sparkContext.broadcast((head, flat, known, stat, discount))
    out_schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("learn", pa.bool_()), ("n_tokens", pa.int64()),
                            ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        head, flat, known, stat, discount = model.value
        shape = Shape(head)
        p, rid = shape.split(flat), TaskContext.get().partitionId() << 33
        # of every known word: its symbol, log10 of the base count, log10 probability inside its class
        number = {w: i for i, w in enumerate(known)}
        count = np.array([*known.values(), 0], dtype=np.float64)
        symbol = np.append(shape.code(list(known)), -1)
        group = np.array([*map(tail_class, known), 0])
        inside = np.where(symbol < len(shape.head), 0.0, np.log10(np.maximum(count - discount[group], 1e-9) / np.maximum(stat[group, 0], 1)))
        base = np.log10(count + 0.5)
        get = number.get
        codes, rare, part, sums, ids, held, tokens = [], [], [], [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal rid, tokens
            value = score(shape, p, codes) / np.log(10) + np.array(part)
            n = np.array([len(x) for x in codes], dtype=np.int64)
            miss = np.array([len(x) for x in rare], dtype=np.int64)
            out = pa.RecordBatch.from_arrays([
                pa.array(rid + np.arange(len(n)), pa.int64()), pa.array(ids, pa.int64()), pa.array(held, pa.bool_()),
                pa.array(n, pa.int64()), pa.array(n - miss, pa.int64()), pa.array(sums, pa.float64()), pa.array(value, pa.float64()),
                pa.array(rare, pa.list_(pa.binary()))], schema=out_schema)
            rid += len(n)
            tokens = 0
            for x in (codes, rare, part, sums, ids, held):
                x.clear()
            return out

        for batch in batches:
            for doc_id, learn, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "learn", "text"))):
                words = _words(text) + [END]
                at = np.array([get(w, -1) for w in words], dtype=np.int64)
                other = np.flatnonzero(at < 0)
                sym = symbol[at].astype(np.int16)
                mine = [words[i] for i in other]
                sym[other] = [len(shape.head) + tail_class(w) for w in mine]
                codes.append(sym)
                rare.append(mine)
                known_at = at[at >= 0]
                part.append(inside[known_at].sum())
                sums.append(base[known_at].sum())
                ids.append(doc_id)
                held.append(learn)
                tokens += len(sym)
                if tokens >= GROUP:
                    yield close()
        if codes:
            yield close()

    done = written(docs.mapInArrow(run, "rid long, doc_id long, learn boolean, n_tokens long, n_known long, base double, "
                                        "score double, rare array<binary>"), "scored")
    table = spark.createDataFrame([(g, float(discount[g]), float(max(stat[g, 0], 1)), float(unseen[g])) for g in range(TAIL)],
                                  "grp int, d double, total double, unseen double")
    rare = done.select("rid", F.explode("rare").alias("word")).join(counts.where(F.col("n") < cut).select("word", "n"), "word", "left")
    rare = rare.withColumn("grp", tail).join(F.broadcast(table), "grp")
    known_part = F.log10((F.col("n") - F.col("d")) / F.col("total"))
    sums = rare.groupBy("rid").agg(
        F.count("n").alias("more"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("base2"),
        F.sum(F.when(F.col("n").isNull(), F.col("unseen")).otherwise(known_part)).alias("score2"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    scale = float(np.log10(whole + 0.5 * (distinct + 1)))
    return done.join(sums, "rid", "left").select(
        "doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", (F.col("n_known") + zero("more")).alias("n_known"),
        F.lit(int(whole)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base2") - F.col("n_tokens") * scale).alias("base_score"),
        (F.col("score") + zero("score2")).alias("score"))
