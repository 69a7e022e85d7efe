"""Language-model scoring with a weighted backoff automaton.

The model: interpolated n-grams with Dirichlet smoothing down to an add-half
unigram model with one class for unknown words,

    P(w | h) = (c(h w) + MASS * P(w | h')) / (c(h) + MASS),

h' being h without its first word. As an automaton: a state for each history
seen in training, an arc for each n-gram seen in training that weighs its
smoothed probability, and a failure arc from h to h' that weighs
MASS / (c(h) + MASS). A text is one left-to-right traversal that carries the
state: where a state has no arc for the next word, failure arcs are taken and
their weights added until one has; the root has an arc for every word.

Counts cover every training text and every n-gram, without cutoffs, so the
automaton grows with the corpus and is never held in one place. Documents are
dealt to blocks of a bounded size. A block sends the distinct hashed n-grams
it contains, with its training counts, to the owners of ranges of hashes; an
owner adds the counts up and answers with the totals in the order of the
question; the block then builds the sub-automaton of its own n-grams (states,
arcs, failure arcs) and traverses its texts with it, all of them in step.

Questions take as many hops as keep each block's messages at `RADIX` a hop: in
hop i the blocks whose numbers differ in digit i only exchange by the i-th
digit of the hash range and merge what they hear, and answers go back the same
way. So messages are in proportion to blocks, not to their square, and what a
task holds stays that of a block or of its share of the n-grams. An n-gram comes
once from each block however often it occurs, so frequent ones are no hot
spot. Nothing goes to the driver but the size of the input.

Tokens are words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased and one end for
each text. N-grams are told apart by 64-bit hashes.

Defined cases: a null or empty text is its end token alone; a very long text is
traversed in runs of `LANE` tokens, each of which takes up the state by reading
the order - 1 tokens before it (a state depends on no more), and a block is
never smaller than its longest text; a null doc_id counts as the empty text for
the choice of training rows; repeated rows each count and are scored each, but
are tokenized and traversed once (rows equal in doc_id and text share a block);
without any training token every probability is the unknown class's; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out_remainder, table, text_bytes

ORDER = 2
MASS = 300.0
BLOCK_BYTES = 16 << 20
#: Messages of a block in one hop, at most.
RADIX = 128
#: Tokens of a run.
LANE = 2048
MODULUS, HELD_OUT = 5, 1

_END = xxhash.xxh3_64_intdigest(b"\n")  # no word holds white space
_START = xxhash.xxh3_64_intdigest(b" ")
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, without its end. Of bytes, lower() and split() know ASCII only."""
    return (text or "").encode(errors="replace").lower().split()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two in order."""
    with np.errstate(over="ignore"):
        h = (a * _C1) ^ (b + (a >> np.uint64(29)))
        h = (h ^ (h >> np.uint64(32))) * _C2
        return h ^ (h >> np.uint64(29))


class Block:
    """The hashed tokens of some texts: `keys[n-1][i]` is the n-gram that ends at position i, cut at the text's start."""

    def __init__(self, texts: list[str | None], order: int):
        place: dict[bytes, int] = {}
        parts: list[np.ndarray] = []
        lengths = np.empty(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            words = tokens(text)
            for w in set(words):
                place.setdefault(w, len(place) + 1)
            ids = np.fromiter(map(place.__getitem__, words), dtype=np.int32, count=len(words))
            parts += [ids, np.zeros(1, dtype=np.int32)]
            lengths[k] = len(words) + 1
        hashes = np.array([_END, *map(xxhash.xxh3_64_intdigest, place)], dtype=np.uint64)
        flat = hashes[np.concatenate(parts)] if parts else np.empty(0, dtype=np.uint64)
        self.lengths = lengths
        self.starts = np.cumsum(lengths) - lengths
        self.place = np.arange(len(flat)) - np.repeat(self.starts, lengths)  # in its text
        self.keys = [flat]
        for n in range(2, order + 1):
            # The n-gram at i is the (n-1)-gram at i-1 and token i; at the start of a text that is the start mark.
            before = np.empty_like(flat)
            before[1:] = self.keys[-1][:-1]
            if len(flat):
                before[self.starts] = np.uint64(_START)
            self.keys.append(_mix(before ^ np.uint64(n), flat))

    def distinct(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct n-grams, and each position's place among them."""
        return np.unique(self.keys[level], return_inverse=True)


ROOT, START = 0, 1


class Automaton:
    """States, arcs and failure arcs over the n-grams of a block.

    `grams[n-1]` is (training count of each distinct n-gram, each position's
    place among them); `total`, `n_words` and `n_texts` are training tokens,
    distinct ones, and texts.
    """

    def __init__(self, block: Block, grams: list[tuple[np.ndarray, np.ndarray]], total: int, n_words: int, n_texts: int, mass: float = MASS):
        self.order = len(grams)
        self.tokens = grams[0][1]
        p = (grams[0][0] + 0.5) / (total + 0.5 * (n_words + 1))
        self.root_weight = np.log10(p)
        self.n_tokens = len(p)
        fail_weight, fail_to = [[0.0, np.log10(mass / (n_texts + mass))]], [[ROOT, ROOT]]
        keys, weights, targets, froms = [], [], [], []
        state_of: list[np.ndarray] = []  # for each level, the state of each distinct n-gram, ROOT where it has none
        n_states = 2
        for n, (count, at) in enumerate(grams, 1):
            where = np.empty(len(count), dtype=np.int64)
            where[at] = np.arange(len(at))  # one position of each distinct n-gram
            seen = np.flatnonzero((count > 0) & (block.place[where] >= n - 2))  # else its history would begin before the start mark
            pos = where[seen]
            if n > 1:
                before, first = pos - 1, block.place[pos] == 0
                history = np.where(first, n_texts, grams[n - 2][0][grams[n - 2][1][before]])
                lower = p[grams[n - 2][1][where]]
                p_seen = (count[seen] + mass * lower[seen]) / (history + mass)
                froms.append(np.where(first, START, state_of[n - 2][grams[n - 2][1][before]]))
                keys.append(froms[-1] * self.n_tokens + self.tokens[pos])
                weights.append(np.log10(p_seen))
                p = np.zeros(len(count))
                p[seen] = p_seen  # only what is seen has arcs above it
            if n < self.order:
                own = np.zeros(len(count), dtype=np.int64)
                own[seen] = n_states + np.arange(len(seen))
                n_states += len(seen)
                state_of.append(own)
                fail_weight.append(np.log10(mass / (count[seen] + mass)))
                fail_to.append(state_of[n - 2][grams[n - 2][1][pos]] if n > 1 else np.zeros(len(seen), dtype=np.int64))
            if n > 1:
                m = min(n, self.order - 1)
                targets.append(state_of[m - 1][grams[m - 1][1][pos]])
        self.root_to = state_of[0] if state_of else np.zeros(self.n_tokens, dtype=np.int64)
        self.fail_weight, self.fail_to = np.concatenate(fail_weight), np.concatenate(fail_to).astype(np.int64)
        none = np.array([np.iinfo(np.int64).max])  # no state has this arc
        key = np.concatenate([*keys, none])
        by_key = np.argsort(key, kind="stable")
        self.arc = key[by_key]
        self.arc_weight = np.concatenate([*weights, [0.0]])[by_key]
        self.arc_to = np.concatenate([*targets, [ROOT]]).astype(np.int64)[by_key]

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and the weights of the arcs taken."""
        weight, to = np.zeros(len(state)), np.empty(len(state), dtype=np.int64)
        left = np.arange(len(state))
        for _ in range(self.order - 1):
            key = state * self.n_tokens + token
            i = np.searchsorted(self.arc, key)
            hit = self.arc[i] == key
            got, arcs = left[hit], i[hit]
            weight[got] += self.arc_weight[arcs]
            to[got] = self.arc_to[arcs]
            miss = ~hit
            left, state, token = left[miss], state[miss], token[miss]
            weight[left] += self.fail_weight[state]
            state = self.fail_to[state]
        weight[left] += self.root_weight[token]
        to[left] = self.root_to[token]
        return to, weight

    def score(self, starts: np.ndarray, lengths: np.ndarray, lane: int = LANE) -> np.ndarray:
        """log10 probability of each text, by one traversal from left to right of all texts in step."""
        n_runs = -(-lengths // lane)
        text = np.repeat(np.arange(len(lengths)), n_runs)
        run = np.arange(len(text)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
        begin = starts[text] + run * lane
        size = np.minimum(lane, lengths[text] - run * lane)
        warm = np.minimum(run * lane, self.order - 1)  # tokens read before the run's own
        begin, size = begin - warm, size + warm
        order = np.argsort(-size, kind="stable")
        text, begin, size, warm = text[order], begin[order], size[order], warm[order]
        state = np.where(begin == starts[text], START, ROOT)
        sums = np.zeros(len(text))
        for t in range(int(size[0]) if len(size) else 0):
            m = int(np.searchsorted(-size, -t, side="left"))  # runs with a token here
            state[:m], weight = self.step(state[:m], self.tokens[begin[:m] + t])
            sums[:m] += weight if t >= self.order - 1 else np.where(t >= warm[:m], weight, 0.0)
        return np.bincount(text, weights=sums, minlength=len(lengths))


def score_text(text: str | None, counts: dict[tuple[bytes, ...], int], total: int, n_words: int, order: int = ORDER, mass: float = MASS) -> float:
    """The formula, token by token, over the counts of all n-grams (tuples of tokens, start and end marks b" " and b"\n"); for tests."""
    history: tuple[bytes, ...] = (b" ",)
    out = 0.0
    for w in [*tokens(text), b"\n"]:
        p = (counts.get((w,), 0) + 0.5) / (total + 0.5 * (n_words + 1))
        for k in range(1, min(len(history), order - 1) + 1):
            h = history[len(history) - k :]
            p = (counts.get((*h, w), 0) + mass * p) / (counts.get(h, 0) + mass)
        out += float(np.log10(p))
        history = (*history, w)[-max(1, order - 1) :]
    return out


def _compact(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)  # low bytes first: the rest is mostly zero


def _counts(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


class Hops:
    """Who asks whom: numbers of blocks and ranges of hashes in the same `depth` digits."""

    def __init__(self, n_blocks: int, radix: int = RADIX):
        self.depth = 1
        while radix**self.depth < n_blocks:
            self.depth += 1
        self.radix = next(r for r in range(1, n_blocks + 1) if r**self.depth >= n_blocks)
        self.width = (1 << 64) // self.radix**self.depth + 1

    def ask(self, node: int, hop: int, keys: list[np.ndarray], counts: list[np.ndarray]) -> list[tuple]:
        """A node's messages (to, frm, keys, counts) in a hop: one to each of its partners, by the ranges of their hashes."""
        own = 0  # the range that the node holds by the digits of the earlier hops
        for i in range(hop):
            own = own * self.radix + node // self.radix**i % self.radix
        step = self.width * self.radix ** (self.depth - 1 - hop)
        low = own * step * self.radix
        bounds = np.array([min(low + j * step, (1 << 64) - 1) for j in range(1, self.radix)], dtype=np.uint64)
        cuts = [[0, *np.searchsorted(k, bounds).tolist(), len(k)] for k in keys]
        digit = node // self.radix**hop % self.radix
        out = []
        for j in range(self.radix):
            parts = [(k[c[j] : c[j + 1]], n[c[j] : c[j + 1]]) for k, n, c in zip(keys, counts, cuts, strict=True)]
            to = node + (j - digit) * self.radix**hop
            out.append((to, node, [k.astype("<u8").tobytes() for k, _ in parts], [_compact(n) for _, n in parts]))
        return out


ASKED = "to long, frm long, keys array<binary>, counts array<binary>"
ANSWERED = "to long, frm long, counts array<binary>, n_tokens long, n_words long"
_BINARIES = pa.list_(pa.binary())


def _rows(out: list[tuple], names: list[str]) -> pa.Table:
    kinds = {"keys": _BINARIES, "counts": _BINARIES}
    return pa.Table.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for c, n in zip(zip(*out, strict=True), names, strict=True)], names=names)


def _questions(t: pa.Table) -> tuple[list[int], list[list[np.ndarray]], list[list[np.ndarray]]]:
    """Who asks (ascending), and for each level the keys and counts of each."""
    t = t.sort_by("frm")
    keys = [[np.frombuffer(b, dtype="<u8") for b in level] for level in zip(*t.column("keys").to_pylist(), strict=True)]
    counts = [[_counts(b) for b in level] for level in zip(*t.column("counts").to_pylist(), strict=True)]
    return t.column("frm").to_pylist(), keys, counts


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their summed counts, and each key's place among them."""
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(inverse, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64), inverse


def _answers(node: int, frm: list[int], keys: list[list[np.ndarray]], totals: list[np.ndarray], places: list[np.ndarray], n_tokens: int, n_words: int) -> pa.Table:
    levels = []
    for k, total, place in zip(keys, totals, places, strict=True):
        levels.append([_compact(x) for x in np.split(total[place], np.cumsum([len(x) for x in k])[:-1])])
    out = [(to, node, list(packed), n_tokens, n_words) for to, packed in zip(frm, zip(*levels, strict=True), strict=True)]
    return _rows(out, ["to", "frm", "counts", "n_tokens", "n_words"])


def _heard(answers: pa.Table) -> tuple[list[np.ndarray], int, int]:
    """The totals of a node's own keys, level by level, and the training tokens and distinct words of all answers."""
    t = answers.sort_by("frm")
    totals = [np.concatenate([_counts(b) for b in level]) for level in zip(*t.column("counts").to_pylist(), strict=True)]
    return totals, sum(t.column("n_tokens").to_pylist()), sum(t.column("n_words").to_pylist())


def relay(hops: Hops, hop: int):
    """Merges what a node heard and asks on, in hop `hop`."""

    def run(t: pa.Table) -> pa.Table:
        _, keys, counts = _questions(t)
        merged = [_merged(k, c)[:2] for k, c in zip(keys, counts, strict=True)]
        return _rows(hops.ask(t.column("to")[0].as_py(), hop, *map(list, zip(*merged, strict=True))), ["to", "frm", "keys", "counts"])

    return run


def answer(t: pa.Table) -> pa.Table:
    """What the owner of a range answers."""
    frm, keys, counts = _questions(t)
    merged = [_merged(k, c) for k, c in zip(keys, counts, strict=True)]
    words = merged[0][1]
    return _answers(t.column("to")[0].as_py(), frm, keys, [m[1] for m in merged], [m[2] for m in merged], int(words.sum()), int((words > 0).sum()))


def hand_back(asked: pa.Table, answers: pa.Table) -> pa.Table:
    """Answers to a node's merged question, dealt to those who had asked it."""
    if not asked.num_rows:
        return pa.Table.from_pylist([], schema=pa.schema([("to", pa.int64()), ("frm", pa.int64()), ("counts", _BINARIES), ("n_tokens", pa.int64()), ("n_words", pa.int64())]))
    frm, keys, _ = _questions(asked)
    totals, n_tokens, n_words = _heard(answers)
    places = [np.unique(np.concatenate(k), return_inverse=True)[1] for k in keys]
    return _answers(asked.column("to")[0].as_py(), frm, keys, totals, places, n_tokens, n_words)


def _block(batches: pa.Table, order: int) -> tuple[Block, np.ndarray, np.ndarray, pa.Table]:
    """A block's distinct rows in an order that doesn't depend on how they arrived, which of them are for training, and how often each occurs."""
    t = batches.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if batches.num_rows else batches
    ids, texts = t.column("doc_id").to_pylist(), t.column("text").to_pylist()
    new = np.array([i == 0 or ids[i] != ids[i - 1] or texts[i] != texts[i - 1] for i in range(len(ids))], dtype=bool)
    first = np.flatnonzero(new)
    t = t.take(pa.array(first))
    train = t.column("train").to_numpy(zero_copy_only=False).astype(np.int64)
    return Block([texts[i] for i in first.tolist()], order), train, np.diff([*first.tolist(), len(ids)]), t


def n_blocks_of(size: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(6, -(-size // block_bytes))


def questions(slim: DataFrame, hops: Hops, order: int = ORDER) -> list[DataFrame]:
    """The messages (to, frm, keys, counts) of each hop; slim: doc_id, text, train, block."""

    def ask(batches: pa.Table) -> pa.Table:
        block, train, times, _ = _block(batches, order)
        weight = np.repeat(train * times, block.lengths)
        keys, counts = [], []
        for level in range(order):
            k, at = block.distinct(level)
            keys.append(k)
            counts.append(np.bincount(at, weights=weight, minlength=len(k)).astype(np.int64))
        return _rows(hops.ask(batches.column("block")[0].as_py(), 0, keys, counts), ["to", "frm", "keys", "counts"])

    asked = [slim.groupBy("block").applyInArrow(ask, ASKED)]
    for hop in range(1, hops.depth):
        asked.append(asked[-1].groupBy("to").applyInArrow(relay(hops, hop), ASKED))
    return asked


def score_documents(
    docs: DataFrame,
    order: int = ORDER,
    mass: float = MASS,
    block_bytes: int = BLOCK_BYTES,
    modulus: int = MODULUS,
    held_out: int = HELD_OUT,
    radix: int = RADIX,
    lane: int = LANE,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams) and score of each row."""
    _, size = text_bytes(docs)
    n = n_blocks_of(size, block_bytes)
    hops = Hops(n, radix)
    slim = blocks_of(docs, n, modulus, held_out)
    asked = questions(slim, hops, order)
    answered = asked[-1].groupBy("to").applyInArrow(answer, ANSWERED)
    for earlier in reversed(asked[:-1]):
        answered = earlier.groupBy("to").cogroup(answered.groupBy("to")).applyInArrow(hand_back, ANSWERED)

    def traverse(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block, train, times, t = _block(texts, order)
        totals, n_tokens, n_words = _heard(answers)
        grams, n_texts = [], 0
        for level in range(order):
            keys, at = block.distinct(level)
            grams.append((totals[level], at))
            block.keys[level] = keys[:0]  # no longer needed
            if level == 0:
                n_texts = int(totals[0][np.searchsorted(keys, np.uint64(_END))])
        automaton = Automaton(block, grams, n_tokens, n_words, n_texts, mass)
        sums = lambda x: np.add.reduceat(x, block.starts)  # noqa: E731  every text has a token
        cols = {
            "doc_id": t.column("doc_id").combine_chunks(),
            "held_out": pa.array(train == 0),
            "n_tokens": pa.array(block.lengths),
            "n_known": pa.array(sums((totals[0] > 0)[automaton.tokens].astype(np.int64))),
            "train_tokens": pa.array(np.full(len(train), n_tokens, dtype=np.int64)),
            "base_score": pa.array(sums(automaton.root_weight[automaton.tokens])),
            "score": pa.array(automaton.score(block.starts, block.lengths, lane)),
        }
        found = pa.table(cols)
        return found if (times == 1).all() else found.take(pa.array(np.repeat(np.arange(len(times)), times)))

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return slim.groupBy("block").cogroup(answered.groupBy("to")).applyInArrow(traverse, schema)


def blocks_of(docs: DataFrame, n: int, modulus: int = MODULUS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, text, train and block of each row."""
    doc_id, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    train = held_out_remainder(docs["doc_id"], modulus) != held_out
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), train.alias("train"), F.pmod(F.xxhash64(doc_id, text), F.lit(n)).cast("long").alias("block"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
