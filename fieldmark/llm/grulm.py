"""Document log-likelihood by a gated recurrent network with a class-factored output.

Tokens are lower-cased words and one end for each document. From all training rows come the words' counts, a table that
stays distributed; the ``FREQUENT`` most frequent go to every worker. A word's class is a hash of its last bytes; the
probability of a word is that of its class given the state, times that of its unit in the class given the state. The
``HEAD`` most frequent words are units; the other words of a class share one unit and are told apart by their counts,
smoothed as the base score is, with one unseen word in each class.

Texts are encoded once, two bytes a token, and stored; training and scoring read the codes.

Training is truncated backpropagation through windows of ``STEPS`` tokens in numpy, by Adagrad, with the state carried
from window to window through whole documents. It covers every training row once, in rounds, each of twice as many
tokens as the one before until a round has ``ROUND_TOKENS`` for each replica; further rounds are of that size. So a
task, and what a lost executor repeats, is bounded by it at any size of the corpus. In a round each replica goes on from the common weights over rows of its own; then the replicas' weights and Adagrad sums are averaged by their numbers
of tokens: blocks of them are shuffled and summed in streams, so neither the driver nor a task holds more than one
replica. Replicas grow in number with the square root of the training tokens, and so do the tokens of each.

Rows are dealt to rounds and replicas, and put in order there, by hashes of their id and content. So the weights don't
depend on how the input is partitioned.

Scoring runs many documents side by side in lanes; the state is carried from window to window, so that each score is
that of the complete document. Words beyond the frequent ones meet their counts in a join.

Rows whose crc32 of the id modulo 5 is 1 are held out; nothing is learned from them.

Defined cases: a null text is the empty text, one end; repeated rows count and are scored as often as they
occur, and equal rows of one id follow one another in one replica; without training rows every count is 0, the base
score of a token is log10(1), and the network stays as it starts; a very long text is encoded in a batch of its own
and trained and scored whole, window by window; a row without an id isn't held out; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import map_rows, materialize, small_batches, temporary

FREQUENT, HEAD, CLASSES, HIDDEN, SUFFIX = 60_000, 1024, 32, 16, 3
#: Steps of a training window, most lanes, tokens of a scoring window, tokens and bytes of text that a task works on at once.
STEPS, LANES, SCORE_TOKENS, CHUNK_TOKENS, CHUNK_BYTES = 32, 192, 16_000, 2_000_000, 8 << 20
RATE, CLIP = 0.25, 1.0
#: There are sqrt(tokens / REPLICA_TOKENS) replicas; the first round has about FIRST_TOKENS for each, none about more than ROUND_TOKENS.
REPLICA_TOKENS, FIRST_TOKENS, ROUND_TOKENS = 750_000, 200_000, 20_000_000
COUNTER_WORDS, BLOCKS = 300_000, 32
#: Least scores lie so far below a bound on them at most, for exponentials that keep their precision in 32 bits.
SAFE = 60.0
#: The end and FREQUENT words have the codes below this; from here on, codes are classes of other words.
RARE = FREQUENT + 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: only A-Z, and the six ASCII spaces


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-SUFFIX:]) % CLASSES


class SuffixClasses(dict):
    """The classes of suffixes that were met; there are few beside the words."""

    def __missing__(self, suffix: bytes) -> int:
        if len(self) >= FREQUENT:
            self.clear()
        self[suffix] = found = class_of(suffix)
        return found


_suffix_classes = SuffixClasses()


def classes_of(words: pa.Array) -> np.ndarray:
    """The class of each word, by its distinct suffixes."""
    suffixes = pc.binary_slice(words.cast(pa.binary()), -SUFFIX).dictionary_encode()
    return np.array(list(map(_suffix_classes.__getitem__, suffixes.dictionary.to_pylist())), np.int32)[suffixes.indices.to_numpy()]


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another, as words_of gives them, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    # blanks around a text leave empty words there
    there = pc.not_equal(words, "")
    kept = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])[ends]
    return words.filter(there), np.diff(kept)


# ---- counts ---------------------------------------------------------------------------------------------------


def count_words(training: DataFrame) -> DataFrame:
    """(word, class, n) over all rows; the empty word stands for the ends."""

    def run(batches):
        seen: Counter = Counter()

        def flush():
            words = pa.array(list(seen), pa.string())
            rows = {"word": words, "class": classes_of(words), "n": pa.array(list(seen.values()), pa.int64())}
            seen.clear()
            return pa.RecordBatch.from_pydict(rows)

        for batch in small_batches(5000, "text")(batches):
            words, lengths = word_lists(batch.column("text"))
            met = words.value_counts()
            for word, n in zip(met.field("values").to_pylist(), met.field("counts").to_pylist()):
                seen[word] += n
            seen[""] += len(lengths)
            if len(seen) >= COUNTER_WORDS:
                yield flush()
        if seen:
            yield flush()

    rows = training.select("text").mapInArrow(run, "word string, class int, n long")
    return rows.groupBy("word").agg(F.first("class").alias("class"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What every worker knows: the frequent words in order, their counts, and totals of all words and of each class's rest."""

    words: list[bytes]  # words[0] is the end
    counts: np.ndarray
    tokens: int
    distinct: int
    rest_tokens: np.ndarray
    rest_words: np.ndarray
    classes: np.ndarray = field(init=False)
    units: np.ndarray = field(init=False)
    sizes: np.ndarray = field(init=False)
    known: pa.Array = field(init=False, repr=False)

    def __post_init__(self):
        self.head = min(HEAD, len(self.words))
        self.classes = np.array([class_of(w) for w in self.words], np.int32)
        # units 0, 1, ... of each class are its head words in order; the last is the rest
        self.sizes = np.bincount(self.classes[: self.head], minlength=CLASSES) + 1
        self.units = np.empty(len(self.words), np.int32)
        next_unit = [0] * CLASSES
        for i, c in enumerate(self.classes):
            self.units[i] = next_unit[c] if i < self.head else self.sizes[c] - 1
            next_unit[c] += i < self.head
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.known = pa.array(self.words[1:], pa.binary()).cast(pa.string())
        self.rest_log = np.log10(self.rest_tokens + 0.5 * (self.rest_words + 1))
        self.base_log = float(np.log10(self.tokens + 0.5 * (self.distinct + 1)))
        self.count_log = np.log10(self.counts + 0.5)

    @property
    def inputs(self) -> int:
        """Rows of the input embedding: head words, then a row for the rest of each class."""
        return self.head + CLASSES


def read_vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    order = [F.desc("n"), F.col("word")]
    # only words as frequent as the last that is wanted, to a part in 16 of a doubling, are sorted: not so many from every task
    level = F.floor(F.log2("n") * 16).alias("level")
    least, seen = 0, 0
    for r in counts.where("word <> ''").groupBy(level).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect():
        least, seen = r["level"], seen + r["words"]
        if seen >= FREQUENT:
            break
    frequent = counts.where("word <> ''").where(level >= least).select("word", "n")
    top = [(r[0].encode(), r[1]) for r in frequent.orderBy(*order).limit(FREQUENT).collect()]
    ends = counts.where("word = ''").select("n").collect()
    words, head = [(b"", ends[0][0] if ends else 0), *top], [w for w, _ in top[: HEAD - 1]]
    tokens, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for c, n, v in counts.groupBy("class").agg(F.sum("n"), F.count(F.lit(1))).collect():
        tokens[c], distinct[c] = n, v
    for w, n in [words[0], *words[1 : len(head) + 1]]:
        tokens[class_of(w)] -= n
        distinct[class_of(w)] -= bool(n)
    return Vocabulary([w for w, _ in words], np.array([n for _, n in words], float), total[0] or 0, total[1], tokens, distinct)


# ---- network --------------------------------------------------------------------------------------------------

Weights = dict[str, np.ndarray]


def new_weights(vocabulary: Vocabulary, seed: int = 11) -> Weights:
    """Random inputs and recurrence; outputs that start as the counts' distribution whatever the state."""
    rng, h = np.random.default_rng(seed), HIDDEN
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    head_counts, rest = vocabulary.counts[: vocabulary.head] + 0.5, vocabulary.rest_tokens + 0.5
    of_class = np.bincount(vocabulary.classes[: vocabulary.head], head_counts, CLASSES) + rest
    units = np.empty(vocabulary.offsets[-1])
    units[vocabulary.offsets[vocabulary.classes[: vocabulary.head]] + vocabulary.units[: vocabulary.head]] = head_counts
    units[vocabulary.offsets[1:] - 1] = rest
    bias = np.zeros(3 * h, np.float32)
    bias[:h] = 1.0  # states start out lasting
    return {
        "E": draw(vocabulary.inputs, 3 * h, scale=0.3), "U": draw(h, 3 * h, scale=0.2), "b": bias,
        "C": draw(h, CLASSES, scale=0.05), "c": np.log(of_class / of_class.sum()).astype(np.float32),
        "W": draw(vocabulary.offsets[-1], h, scale=0.02), "w": np.log(units).astype(np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def run_window(p: Weights, state: np.ndarray, inputs: np.ndarray, keep: np.ndarray):
    """States after each step of a window, and what backpropagation needs. inputs, keep: steps x lanes."""
    steps, lanes = inputs.shape
    h = HIDDEN
    x = p["E"].take(inputs, axis=0)
    x += p["b"]
    before, gates, fresh, inner = (np.empty((steps, lanes, n), np.float32) for n in (h, 2 * h, h, h))
    after = np.empty((steps, lanes, h), np.float32)
    u = p["U"]
    for t in range(steps):
        last = np.multiply(state, keep[t][:, None], out=before[t])
        a = last @ u
        zr = np.add(x[t, :, : 2 * h], a[:, : 2 * h], out=gates[t])
        _sigmoid(zr)
        inner[t] = a[:, 2 * h :]
        n = np.multiply(zr[:, h:], a[:, 2 * h :], out=fresh[t])
        n += x[t, :, 2 * h :]
        np.tanh(n, out=n)
        state = np.subtract(last, n, out=after[t])
        state *= zr[:, :h]
        state += n
    return after, before, gates, fresh, inner


def _picked(table: np.ndarray, between: tuple[float, float], states: np.ndarray, which: np.ndarray, grads: np.ndarray | None, back: np.ndarray | None) -> np.ndarray:
    """Log-probability of the row of ``table`` picked for each state, by a softmax over its rows; adds to the gradients if wanted.

    table and states have a last column more, the biases and ones. The largest score of any state lies between ``between``,
    from high to low; where these are near enough, all are shifted by the first, in the biases, instead of by each state's largest.
    """
    high, low = between
    if high - low < SAFE:
        table = np.concatenate([table[:, :-1], table[:, -1:] - high], axis=1)
    x = table @ states.T
    if high - low >= SAFE:
        x -= x.max(axis=0)
    at = np.arange(len(states))
    found = x[which, at]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    if grads is not None:
        # probabilities less one for the picked are x / total; the few columns of states and back are divided instead
        x[which, at] -= total
        each = np.reciprocal(total)[:, None]
        grads += x @ (states * each)
        back += (x.T @ table[:, :-1]) * each
    return found - np.log(total)


def outputs(p: Weights, offsets: np.ndarray, states: np.ndarray, classes: np.ndarray, units: np.ndarray, grads: Weights | None = None):
    """Natural log of each token's class and unit probability; with grads, adds to them and returns the states' gradient too."""
    order = np.argsort(classes.astype(np.int8), kind="stable")
    wide = np.ones((len(states), states.shape[1] + 1), states.dtype)
    wide[:, :-1] = states.take(order, axis=0)
    classes, units = classes[order], units[order]
    of_classes, of_units = np.column_stack([p["C"].T, p["c"]]), np.column_stack([p["W"], p["w"]])
    # states lie between -1 and 1
    around = [(x[:, -1], np.abs(x[:, :-1]).sum(axis=1)) for x in (of_classes, of_units)]
    of_class = [float((bias + sign * most).max()) for bias, most in around[:1] for sign in (1, -1)]
    of_unit = [np.maximum.reduceat(bias + sign * most, offsets[:-1]).tolist() for bias, most in around[1:] for sign in (1, -1)]
    back = by_classes = by_units = None
    if grads is not None:
        back, by_classes, by_units = np.zeros_like(states), np.zeros_like(of_classes), np.zeros_like(of_units)
    found = _picked(of_classes, tuple(of_class), wide, classes, by_classes, back)
    start = 0
    for c, end in enumerate(np.cumsum(np.bincount(classes, minlength=CLASSES)).tolist()):
        if end == start:
            continue
        o, r = slice(offsets[c], offsets[c + 1]), slice(start, end)
        found[r] += _picked(of_units[o], (of_unit[0][c], of_unit[1][c]), wide[r], units[r], None if grads is None else by_units[o], None if grads is None else back[r])
        start = end
    in_order = np.empty_like(found)
    in_order[order] = found
    if grads is None:
        return in_order, None
    grads["C"] += by_classes[:, :-1].T
    grads["c"] += by_classes[:, -1]
    grads["W"] += by_units[:, :-1]
    grads["w"] += by_units[:, -1]
    back_in_order = np.empty_like(back)
    back_in_order[order] = back
    return in_order, back_in_order


class Trainer:
    """Adagrad over windows; rows of the inputs that a window doesn't meet aren't touched."""

    def __init__(self, weights: Weights, vocabulary: Vocabulary, sums: Weights | None = None):
        self.p, self.v, self.tokens = {k: x.copy() for k, x in weights.items()}, vocabulary, 0
        self.sums = {k: x.copy() for k, x in sums.items()} if sums else {k: np.full_like(x, 1e-2) for k, x in weights.items()}
        self.grads = {k: np.zeros_like(x) for k, x in weights.items() if k not in ("E", "U", "b")}

    def _move(self, k: str, g: np.ndarray, rows=...):
        self.sums[k][rows] += g * g
        self.p[k][rows] -= RATE * g / np.sqrt(self.sums[k][rows])

    def window(self, state: np.ndarray, inputs, keep, classes, units, valid) -> tuple[np.ndarray, float]:
        h, p = HIDDEN, self.p
        after, before, gates, fresh, inner = run_window(p, state, inputs, keep)
        flat = np.flatnonzero(valid.ravel())
        for g in self.grads.values():
            g.fill(0)
        found, back = outputs(p, self.v.offsets, after.reshape(-1, h)[flat], classes.ravel()[flat], units.ravel()[flat], self.grads)
        d_after = np.zeros((after.shape[0] * after.shape[1], h), np.float32)
        d_after[flat] = back
        d_after = d_after.reshape(after.shape)
        # derivatives of the gates and the fresh value, for all steps at once
        z, r = gates[:, :, :h], gates[:, :, h:]
        stays = 1 - z
        by_z = (before - fresh) * z
        by_z *= stays
        by_n = stays * (1 - fresh * fresh)
        by_r = inner * r
        by_r *= 1 - r
        d_x = np.empty((*after.shape[:2], 3 * h), np.float32)
        d_inner = np.empty_like(after)
        ut, later = np.ascontiguousarray(p["U"].T), np.zeros_like(state)
        for t in range(len(after) - 1, -1, -1):
            d = d_after[t]
            d += later
            n = np.multiply(d, by_n[t], out=d_x[t, :, 2 * h :])
            np.multiply(d, by_z[t], out=d_x[t, :, :h])
            np.multiply(n, by_r[t], out=d_x[t, :, h : 2 * h])
            later = d_x[t, :, : 2 * h] @ ut[: 2 * h]
            later += np.multiply(n, r[t], out=d_inner[t]) @ ut[2 * h :]
            d *= z[t]
            later += d
            later *= keep[t][:, None]
        scale = np.float32(1 / max(1, len(flat)) ** 0.5)
        last = before.reshape(-1, h).T
        every = {"U": np.concatenate([last @ d_x.reshape(-1, 3 * h)[:, : 2 * h], last @ d_inner.reshape(-1, h)], axis=1), "b": d_x.reshape(-1, 3 * h).sum(axis=0), **self.grads}
        for k, g in every.items():
            g *= scale
            np.clip(g, -CLIP, CLIP, out=g)
            self._move(k, g)
        ids = inputs.ravel()
        order = np.argsort(ids.astype(np.int16) if self.v.inputs < 2**15 else ids, kind="stable")  # short integers sort by radix
        sorted_ids = ids[order]
        starts = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
        g = np.add.reduceat(d_x.reshape(-1, 3 * h).take(order, axis=0), starts, axis=0)
        g *= scale
        np.clip(g, -CLIP, CLIP, out=g)
        self._move("E", g, sorted_ids[starts])
        self.tokens += len(flat)
        return after[-1].copy(), float(found.sum())


# ---- documents in lanes ---------------------------------------------------------------------------------------


@dataclass
class Tokens:
    """The tokens of some documents, one after another: index of a frequent word or -1, class, unit, and each document's length."""

    index: np.ndarray
    classes: np.ndarray
    units: np.ndarray
    lengths: np.ndarray


@dataclass
class Coded:
    """Documents' tokens, one after another, as numbers of 16 bits: a frequent word's index, or RARE and the class; and each one's other words."""

    codes: np.ndarray
    lengths: np.ndarray
    others: pa.ListArray

    @property
    def rare(self) -> list[list[bytes]]:
        return [[w.encode() for w in words] for words in self.others.to_pylist()]


def coded(texts: pa.Array | list[str | None], v: Vocabulary) -> Coded:
    words, n = word_lists(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    found = pc.index_in(words, value_set=v.known.cast(words.type))
    rest = found.is_null()
    index = pc.add(found, 1).fill_null(0).to_numpy().astype(np.uint16)
    others, unknown = words.filter(rest), rest.to_numpy(zero_copy_only=False)
    index[unknown] = RARE + classes_of(others)
    lengths = n.astype(np.int64) + 1
    codes, ends = np.zeros(len(words) + len(n), np.uint16), np.cumsum(lengths) - 1
    own = np.ones(len(codes), bool)
    own[ends] = False
    codes[own] = index
    to = np.concatenate([[0], np.cumsum(unknown)])[np.concatenate([[0], np.cumsum(n)]).astype(np.int64)]
    return Coded(codes, lengths, pa.ListArray.from_arrays(pa.array(to, pa.int32()), others.cast(pa.string())))


def tokens_from(codes: np.ndarray, lengths: np.ndarray, v: Vocabulary) -> Tokens:
    index = codes.astype(np.int32)
    unknown = np.flatnonzero(codes >= RARE)
    index[unknown] = -1
    classes, units = v.classes[index], v.units[index]
    classes[unknown] = codes[unknown].astype(np.int32) - RARE
    units[unknown] = v.sizes[classes[unknown]] - 1
    return Tokens(index, classes, units, lengths)


def tokens_of(texts: list[str | None], v: Vocabulary) -> Tokens:
    c = coded(texts, v)
    return tokens_from(c.codes, c.lengths, v)


def in_lanes(t: Tokens, v: Vocabulary):
    """Arrays steps x lanes of inputs, keep, classes, units, places (of the tokens; -1: none), whole documents dealt by length."""
    starts, lengths = np.cumsum(t.lengths) - t.lengths, t.lengths
    lanes = int(np.clip(lengths.sum() // lengths.max(), 1, LANES))
    heap, dealt = [(0, i) for i in range(lanes)], [[] for _ in range(lanes)]
    for d in np.argsort(-lengths, kind="stable").tolist():
        n, lane = heap[0]
        heapq.heapreplace(heap, (n + int(lengths[d]), lane))
        dealt[lane].append(d)
    longest = max(n for n, _ in heap)
    longest += -longest % STEPS
    inputs, keep = np.zeros((lanes, longest), np.intp), np.ones((lanes, longest), np.float32)
    places = np.full((lanes, longest), -1, np.intp)
    # the input for a token is the token before it; for a document's first, the end
    own = np.where((t.index >= 0) & (t.index < v.head), t.index, v.head + t.classes).astype(np.intp)
    before = np.concatenate([[0], own[:-1]]).astype(np.intp)
    before[starts] = 0
    for lane, docs in enumerate(dealt):
        at = 0
        for d in docs:
            n, s = int(lengths[d]), int(starts[d])
            inputs[lane, at : at + n] = before[s : s + n]
            places[lane, at : at + n] = np.arange(s, s + n)
            keep[lane, at] = 0
            at += n
    places = np.ascontiguousarray(places.T)
    return np.ascontiguousarray(inputs.T), np.ascontiguousarray(keep.T), t.classes.take(places), t.units.take(places), places


def train_on(trainer: Trainer, t: Tokens) -> float:
    """One pass over the tokens, states carried through whole documents; the natural log-likelihood met on the way."""
    inputs, keep, classes, units, places = in_lanes(t, trainer.v)
    state, total = np.zeros((inputs.shape[1], HIDDEN), np.float32), 0.0
    for at in range(0, len(inputs), STEPS):
        w = slice(at, at + STEPS)
        state, found = trainer.window(state, inputs[w], keep[w], classes[w], units[w], places[w] >= 0)
        total += found
    return total


def score_tokens(p: Weights, v: Vocabulary, t: Tokens) -> np.ndarray:
    """Natural log of class and unit probability of each token, states carried through whole documents."""
    inputs, keep, classes, units, places = in_lanes(t, v)
    state, found = np.zeros((inputs.shape[1], HIDDEN), np.float32), np.zeros(len(t.index))
    steps = max(STEPS, SCORE_TOKENS // inputs.shape[1])
    for at in range(0, len(inputs), steps):
        w = slice(at, at + steps)
        after = run_window(p, state, inputs[w], keep[w])[0]
        state = after[-1]
        flat = np.flatnonzero((places[w] >= 0).ravel())
        found[places[w].ravel()[flat]] = outputs(p, v.offsets, after.reshape(-1, HIDDEN)[flat], classes[w].ravel()[flat], units[w].ravel()[flat])[0]
    return found


# ---- training over all rows -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rounds:
    """How many replicas so many training tokens have, how many rounds of doubling size, and how many more of the last one's size."""

    replicas: int
    rounds: int
    further: int = 0

    @classmethod
    def of(cls, tokens: int) -> Rounds:
        replicas = max(1, math.ceil(math.sqrt(tokens / REPLICA_TOKENS)))
        each = tokens / replicas
        rounds = max(1, math.ceil(math.log2(each / FIRST_TOKENS + 1)))
        if each * 2 ** (rounds - 1) <= ROUND_TOKENS * (2**rounds - 1):
            return cls(replicas, rounds)
        rounds = 1 + int(math.log2(ROUND_TOKENS / FIRST_TOKENS))
        return cls(replicas, rounds, math.ceil(each / ROUND_TOKENS - (2**rounds - 1) / 2 ** (rounds - 1)))

    @property
    def last(self) -> int:
        return self.rounds + self.further - 1

    def replica(self, key: Column) -> Column:
        return F.pmod(key, F.lit(self.replicas)).cast("int")

    def round(self, key: Column) -> Column:
        """Shares of 1, 2, 4, ... of all rows, then further ones as large as the last of these."""
        doubling, most = 2**self.rounds - 1, 2 ** (self.rounds - 1)
        at = F.shiftrightunsigned(F.xxhash64(key), 11) / 2.0**53 * (doubling + self.further * most)
        number = F.when(at < doubling, F.floor(F.log2(at + 1))).otherwise(self.rounds + F.floor((at - doubling) / most))
        return F.least(number, F.lit(self.last)).cast("int")


def chunks_of(codes: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents' codes in the order given, joined to chunks that end with the document that fills CHUNK_TOKENS; and their lengths."""
    held, n = [], 0
    for c in codes:
        held.append(c)
        n += len(c)
        if n >= CHUNK_TOKENS:
            yield np.concatenate(held), np.array([len(x) for x in held], np.int64)
            held, n = [], 0
    if held:
        yield np.concatenate(held), np.array([len(x) for x in held], np.int64)


def train_replica(trainer: Trainer, codes: Iterator[np.ndarray]) -> None:
    for joined, lengths in chunks_of(codes):
        train_on(trainer, tokens_from(joined, lengths, trainer.v))


def train(tokens: DataFrame, v: Vocabulary, plan: Rounds) -> Weights:
    """Rounds of replicas, each followed by an average, over the training rows of encode()."""
    weights, spark = new_weights(v), tokens.sparkSession
    sums = Trainer(weights, v).sums
    names, sizes = list(weights), [weights[k].size for k in weights]
    flat = lambda x: np.concatenate([x[k].ravel() for k in names]).astype(np.float64)
    back = lambda x: {k: part.astype(np.float32).reshape(weights[k].shape) for k, part in zip(names, np.split(x, np.cumsum(sizes)[:-1]))}
    schema = "block int, tokens long, sums binary"

    def added(batches):
        kept: dict[int, list] = {}
        for batch in batches:
            for b, n, raw in zip(batch.column("block").to_pylist(), batch.column("tokens").to_pylist(), batch.column("sums")):
                part = np.frombuffer(raw.as_py(), np.float64)
                kept[b] = [kept[b][0] + n, kept[b][1] + part] if b in kept else [n, part]
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(kept), pa.int32()), "tokens": pa.array([x[0] for x in kept.values()], pa.int64()), "sums": pa.array([x[1].tobytes() for x in kept.values()], pa.binary())})

    for number in range(plan.last + 1):
        shared = spark.sparkContext.broadcast((v, weights, sums))  # bounded by FREQUENT, HEAD and HIDDEN

        def replica(batches, shared=shared):
            v, weights, sums = shared.value
            trainer = Trainer(weights, v, sums)
            train_replica(trainer, (np.frombuffer(c.as_buffer(), np.uint16) for b in batches for c in b.column("codes")))
            if trainer.tokens:
                blocks = np.array_split(np.concatenate([flat(trainer.p), flat(trainer.sums)]) * trainer.tokens, BLOCKS)
                yield pa.RecordBatch.from_pydict({"block": pa.array(range(BLOCKS), pa.int32()), "tokens": pa.array([trainer.tokens] * BLOCKS, pa.int64()), "sums": pa.array([b.tobytes() for b in blocks], pa.binary())})

        rows = tokens.where(F.col("round") == number).select("replica", "key", "doc_id", "codes")
        # one partition for each replica, its rows in an order of their own
        rows = rows.repartitionById(plan.replicas, "replica").sortWithinPartitions("key", "doc_id", "codes")
        replicas = rows.select("codes").mapInArrow(replica, schema)
        total = replicas.repartition(BLOCKS, "block").mapInArrow(added, schema).orderBy("block").collect()  # one replica's size
        if total:
            mean = np.concatenate([np.frombuffer(r["sums"], np.float64) / r["tokens"] for r in total])
            weights, sums = back(mean[: sum(sizes)]), back(mean[sum(sizes) :])
        shared.destroy()
    return weights


# ---- scores ---------------------------------------------------------------------------------------------------

TOKENS = "row long, doc_id long, n_tokens long, n_known long, base double, codes binary, rare array<string>"


def encode(docs: DataFrame, v: Vocabulary, plan: Rounds) -> DataFrame:
    """Each row's codes, what is known of its counts, its words beyond the frequent ones, and where it is trained (round -1: nowhere).

    Rows of a round lie together in each file, so that a round's scan skips pages of the others.
    """
    shared = docs.sparkSession.sparkContext.broadcast(v)  # bounded by FREQUENT

    def make():
        v = shared.value
        row = TaskContext.get().partitionId() << 33

        def work(batch: pa.RecordBatch) -> dict:
            nonlocal row
            c = coded(batch.column("text"), v)
            frequent = c.codes < RARE
            index = np.where(frequent, c.codes, 0)
            known = np.where(frequent, v.count_log[index], 0.0)  # other words' logs follow from the join
            at = np.cumsum(c.lengths) - c.lengths
            rows = np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            bytes_at = np.append(at, len(c.codes)).astype(np.int32) * 2
            codes = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(bytes_at), pa.py_buffer(c.codes)])
            return {
                "row": rows, "doc_id": batch.column("doc_id"), "n_tokens": c.lengths, "n_known": np.add.reduceat((frequent & (v.counts[index] > 0)).astype(np.int64), at),
                "base": np.add.reduceat(known, at) - c.lengths * v.base_log, "codes": codes, "rare": c.others,
            }

        return work

    rows = map_rows(docs, ["doc_id", "text"], TOKENS, make, "text", 20_000, CHUNK_BYTES)
    key = F.xxhash64("doc_id", "codes")
    placed = rows.withColumns({"key": key, "replica": plan.replica(key), "round": F.when(held_out(F.col("doc_id")), -1).otherwise(plan.round(key))})
    return placed.sortWithinPartitions("round")


def score_rows(tokens: DataFrame, v: Vocabulary, weights: Weights) -> DataFrame:
    """(row, lm): each row's log10 probability without the counts of its words beyond the frequent ones."""
    shared = tokens.sparkSession.sparkContext.broadcast((v, weights))  # bounded by FREQUENT, HEAD and HIDDEN

    def make():
        v, p = shared.value

        def work(batch: pa.RecordBatch) -> dict:
            each = [np.frombuffer(c.as_buffer(), np.uint16) for c in batch.column("codes")]
            t = tokens_from(np.concatenate(each), np.array([len(c) for c in each], np.int64), v)
            lm = score_tokens(p, v, t) / np.log(10)
            rest = (t.index < 0) | (t.index >= v.head)
            lm[rest] -= v.rest_log[t.classes[rest]]
            frequent = t.index >= v.head
            lm[frequent] += v.count_log[t.index[frequent]]
            return {"row": batch.column("row"), "lm": np.add.reduceat(lm, np.cumsum(t.lengths) - t.lengths)}

        return work

    return map_rows(tokens, ["row", "codes"], "row long, lm double", make, "codes", 20_000, 2 * CHUNK_TOKENS)


def _log_likelihoods(docs: DataFrame) -> DataFrame:
    training = docs.where(~held_out(F.col("doc_id")))
    counts = materialize(count_words(training), "word-counts")
    v = read_vocabulary(counts)
    plan = Rounds.of(v.tokens)
    tokens = materialize(encode(docs, v, plan), "lm-tokens")
    scores = materialize(score_rows(tokens, v, train(tokens, v, plan)), "lm-scores")
    rare = tokens.select("row", F.explode("rare").alias("word"))
    # counts have one row for each word, so no key is hot on the side that is hashed
    met = rare.join(counts.select("word", "n").hint("shuffle_hash"), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = met.groupBy("row").agg(F.sum(F.log10(F.col("n") + 0.5)).alias("logs"), F.count_if(F.col("n") > 0).alias("met"))
    both = tokens.select("row", "doc_id", "n_tokens", "n_known", "base").join(scores, "row").join(sums, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return both.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("lm") + logs).alias("score"),
    )


def log_likelihoods(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every row, as a stored table."""
    with temporary(docs.sparkSession):
        return materialize(_log_likelihoods(docs.select("doc_id", "text")), "lm-likelihoods", outer=True)
