"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Only lengths matter to the packing, and a length is at most the capacity, so
the corpus is folded to a histogram of at most `capacity` rows whatever its
size. The histogram is packed on the driver by bin completion: best-fit
decreasing gives the incumbent; where it isn't proven optimal by the waste
bound, a branch and bound takes the largest remaining length, enumerates
the undominated fillings of the rest of its sequence in order of waste, up to
the waste at which the incumbent can't be beaten, and completes some of its
partial plans by best fit. A filling is applied to as many sequences at once
as the counts allow, so the search does not grow with the corpus either. It
ends after `NODES` nodes or `STEPS` enumeration steps (parameters); the
incumbent then stands.

Every piece then gets its rank among the pieces of its length, by a window
over (length, salt) plus the counts of the earlier salts, and the rank picks
its sequence and offset in the plan (broadcast; it holds a few entries for each
length). A length that a third of all rows share is spread over the salts.

Documents are tokenized once; their slim pieces are checkpointed.

Defined cases: a null or empty text is the one token `end_id`; documents
longer than the capacity, and only they, are cut into full pieces and a rest,
however long they are; null doc_ids and repeated rows are packed row by row,
and spread over the salts by where they stand in the checkpointed table; an
empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import json
import operator
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, kept, table

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Nodes of the search, and steps of all its enumerations.
NODES, STEPS = 1_000, 300_000
#: Nodes that keep their tables.
LIVE = 32
#: Rows for each rank window, about.
SALT_ROWS = 200_000


# --- tokenizing ---------------------------------------------------------------------------------------------------


_ID = operator.attrgetter("id")


class WordEncoder:
    """Token ids of whole texts from ids of their white-space parted words.

    The tokenizer's own parts never cross white space, and its normalizer
    works within words, so a text's ids are its words' ids in a row. Ids of
    words are kept (up to `most` words or `most_bytes`, then the store starts
    anew, so that it never holds more than one text beyond that). Words of
    Latin letters are parted by the tokenizer's own pattern and go straight
    to its model, part by part; any other word takes the tokenizer's whole
    path, and so does a whole text that holds one of the tokenizer's added
    tokens.
    """

    #: Control characters, no-break space, and what lies beyond the Latin blocks.
    OTHER = re.compile("[\x00-\x1f\x7f-\xa0]|[^\x00-\u024f]")

    def __init__(self, path: str, most: int = 600_000, most_bytes: int = 64 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec["added_tokens"]]
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.pattern = None
        if normal == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"]:
            self.pattern = regex.compile(parts[0]["pattern"]["Regex"])
        shows = [("aé", ["aé"]), *((f"aé{c}", ["aé", c]) for c in ".,|!")]
        self.letters_are_parts = self.pattern is not None and all(self.pattern.findall(w) == p for w, p in shows)
        # ByteLevel's alphabet: printable Latin-1 characters stand for themselves, other bytes follow from U+0100 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [c for c in range(256) if c not in shown]
        self.alphabet = {c: 256 + i for i, c in enumerate(hidden)}
        self.most, self.most_bytes = most, most_bytes
        self.parts: dict[str, bytes] = {}  # ids as packed 32-bit numbers
        self.part_bytes = 0
        self._reset()

    def _reset(self) -> None:
        self.word_bytes = 0
        self.place: dict[bytes, int] = {}
        self.ids = np.empty(1 << 16, dtype=np.uint32)
        self.starts = np.empty(1 << 16, dtype=np.int64)
        self.lengths = np.empty(1 << 16, dtype=np.int64)
        self.used = 0

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= self.most * 2 // 3 or self.part_bytes > self.most_bytes:
                self.parts.clear()
                self.part_bytes = 0
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.alphabet)  # ASCII parts are printable
            ids = self.parts[part] = array("I", map(_ID, self.model.tokenize(shown))).tobytes()
            self.part_bytes += len(part) + len(ids)
        return ids

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if text.isascii():
            latin = text.isprintable()
        elif latin := not self.OTHER.search(text):
            text = unicodedata.normalize("NFC", text).lower()
        if self.pattern is None or not latin:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if self.letters_are_parts:  # spares most words the pattern
            if text.isalpha():
                return self._part(text)
            if text[-1] in ".,|!" and text[:-1].isalpha():
                return self._part(text[:-1]) + self._part(text[-1])
        return b"".join(map(self._part, self.pattern.findall(text)))

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.empty(max(n, 2 * len(a)) - len(a), dtype=a.dtype)])

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word; words of ASCII letters, alone or before one mark, are told without decoding the others."""
        if not self.letters_are_parts:
            return list(map(self._word, words))
        out, known = [], self.parts.get
        marks = {ord(c): self._part(c) for c in ".,|!"}
        for word in words:
            letters, mark = word, b""
            if not word.isalpha() and word[-1] in marks:
                letters, mark = word[:-1], marks[word[-1]]
            if letters.isalpha():  # of bytes: ASCII letters
                text = letters.decode()
                out.append((known(text) or self._part(text)) + mark)
            else:
                out.append(self._word(word))
        return out

    def _learn(self, new: list[bytes]) -> None:
        ids = self._ids_of(new)
        n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), dtype=np.uint32)
        k = len(self.place)
        self.ids = self._room(self.ids, self.used + len(flat))
        self.starts, self.lengths = (self._room(a, k + len(new)) for a in (self.starts, self.lengths))
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[k : k + len(new)] = self.used + np.cumsum(n) - n
        self.lengths[k : k + len(new)] = n
        self.place.update(zip(new, range(k, k + len(new)), strict=True))
        self.used += len(flat)
        self.word_bytes += sum(map(len, new)) + 4 * len(flat)

    def _places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the store, or -1; one look-up a word."""
        return np.fromiter(map(self.place.get, words, itertools.repeat(-1)), dtype=np.int64, count=len(words))

    def encode(self, text: str) -> np.ndarray:
        if any(token in text for token in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        found = text.encode(errors="replace").lower().split()  # of bytes: ASCII letters and ASCII white space
        if not found:
            return np.empty(0, dtype=np.uint32)
        at = self._places(found)
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            unknown = [found[i] for i in missing]
            new = list(dict.fromkeys(unknown))
            if self.place and (len(self.place) + len(new) > self.most or self.word_bytes > self.most_bytes):
                self._reset()
                self._learn(list(dict.fromkeys(found)))
                at = self._places(found)
            else:
                self._learn(new)
                at[missing] = self._places(unknown)
        n = self.lengths[at]
        ends = np.cumsum(n)
        gather = np.repeat(self.starts[at] - (ends - n), n) + np.arange(int(ends[-1]))
        return self.ids[gather]


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, kept across its tasks until those of another operator come."""
    return kept(f"encoder {path}", lambda: WordEncoder(path))


PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(
    docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """The pieces of every document; with_ids: their token ids too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(public_tokenizers.path(tokenizer))
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(enc.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4", copy=False)
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    row = (doc_id, k, start, len(part), zlib.crc32(part), part)
                    for col, value in zip(out, row, strict=True):
                        col.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            n = 6 if with_ids else 5
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:n]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:n], kinds[:n], strict=True)], names=names)

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return slim.mapInArrow(run, PIECE_SCHEMA + (", ids array<int>" if with_ids else ""))


# --- packing a histogram ------------------------------------------------------------------------------------------

#: A plan: (filling, number of sequences with it); a filling: ((length, how many), ...), largest first.
Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def n_sequences(plan: Plan) -> int:
    return sum(m for _, m in plan)


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """The Martello-Toth bound: lengths over capacity - k stand alone, those over half can't share, and the rest fills gaps."""
    if not hist:
        return 0
    x = np.array(sorted(hist), dtype=np.int64)
    c = np.array([hist[int(v)] for v in x], dtype=np.int64)
    n_up_to = np.concatenate([[0], np.cumsum(c)])
    sum_up_to = np.concatenate([[0], np.cumsum(c * x)])
    half = int(np.searchsorted(x, capacity // 2, side="right"))
    k = np.concatenate([[0], x[:half]])
    top = np.searchsorted(x, capacity - k, side="right")  # lengths from there on stand alone
    sharing = n_up_to[np.maximum(top, half)] - n_up_to[half]
    spare = sharing * capacity - (sum_up_to[np.maximum(top, half)] - sum_up_to[half])
    small = sum_up_to[half] - sum_up_to[np.searchsorted(x, k)]
    alone = n_up_to[-1] - n_up_to[np.maximum(top, half)]
    bounds = alone + sharing + np.maximum(0, -(-(small - spare) // capacity))
    return int(max(bounds.max(), -(-sum_up_to[-1] // capacity)))


def best_fit(hist: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over counts: each length, largest first, goes to the fullest sequences that it fits."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = {capacity: []}
    rooms = [capacity]

    def put(room: int, filling: dict[int, int], times: int) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((filling, times))

    for x in sorted(hist, reverse=True):
        left = hist[x]
        while left:
            i = bisect.bisect_left(rooms, x)
            while i < len(rooms) and not open_[rooms[i]]:
                del open_[rooms[i]], rooms[i]
            if i == len(rooms):
                each = capacity // x
                put(capacity, {}, -(-left // each))
                continue
            room = rooms[i]
            filling, times = open_[room].pop()
            each = room // x
            full = min(times, left // each)
            if full:
                put(room - each * x, filling | {x: filling.get(x, 0) + each}, full)
            left -= full * each
            times -= full
            if times and left:  # fewer than `each` are left: the last sequence that takes any
                put(room - left * x, filling | {x: filling.get(x, 0) + left}, 1)
                left, times = 0, times - 1
            if times:
                put(room, filling, times)
    out: dict[tuple, int] = {}
    for groups in open_.values():
        for filling, times in groups:
            if filling:
                key = tuple(sorted(filling.items(), reverse=True))
                out[key] = out.get(key, 0) + times
    return sorted(out.items(), reverse=True)


class Steps:
    """A budget of enumeration steps, shared by all nodes of a search."""

    def __init__(self, left: int | None = None):
        self.left = left

    def take(self, n: int = 1) -> bool:
        if self.left is not None:
            self.left -= n
        return self.left is None or self.left >= 0


def _add_sums(sums: int, length: int, times: int) -> int:
    """A bit set of subset sums, with up to `times` more items of a length."""
    k = 1
    while times > 0:
        take = min(k, times)
        sums |= sums << take * length
        times -= take
        k *= 2
    return sums


def fillings(counts: dict[int, int], room: int, most_waste: int | None = None, steps: Steps | None = None) -> Iterator[tuple[tuple[int, int], ...]]:
    """The undominated fillings ((length, how many), ...; largest first) of `room`, least waste first.

    A filling is dominated if one more remaining length fits, or if some of its
    lengths can be traded for one remaining length that is at least as long as
    they are together. They come one by one: nothing beyond what is asked for
    is enumerated. Ends early if `steps` runs out.
    """
    steps = steps or Steps()
    fit = sorted(x for x, c in counts.items() if c > 0 and x <= room)
    most_waste = room if most_waste is None else min(room, most_waste)
    if not fit:
        if room <= most_waste:
            yield ()
        return
    mask = (1 << (room + 1)) - 1
    reach = [1]  # of the i least lengths
    for x in fit:
        reach.append(_add_sums(reach[-1], x, min(counts[x], room // x)) & mask)

    def dominated(chosen: tuple[tuple[int, int], ...], waste: int) -> bool:
        taken = dict(chosen)
        least = next((x for x in fit if counts[x] > taken.get(x, 0)), None)
        if least is None:
            return False
        if least <= waste:
            return True
        sums, at = 1, len(chosen) - 1
        for x in fit[bisect.bisect_right(fit, chosen[-1][0]) :]:
            while at >= 0 and chosen[at][0] < x:
                sums = _add_sums(sums, *chosen[at])
                at -= 1
            low = max(1, x - waste)
            if counts[x] > taken.get(x, 0) and sums >> low & ((1 << (x - low + 1)) - 1):
                return True
        return False

    def extend(left: int, i: int, chosen: tuple[tuple[int, int], ...], waste: int) -> Iterator[tuple[tuple[int, int], ...]]:
        """Fillings that add lengths of fit[:i] with a sum of `left`."""
        if not steps.take():
            return
        taken = dict(chosen)
        last = False
        for x in fit[bisect.bisect_left(fit, left) : bisect.bisect_right(fit, left + waste)]:
            if left and counts[x] > taken.get(x, 0):  # it could stand for all that is to come
                if x > left or bisect.bisect_left(fit, x) >= i:
                    return
                last = True
        if last:
            chosen, left = (*chosen, (left, 1)), 0
        if not left:
            if steps.take(1 + len(fit) // 16) and not dominated(chosen, waste):
                yield chosen
            return
        for k in range(min(i, bisect.bisect_right(fit, left)) - 1, -1, -1):
            x = fit[k]
            for times in range(min(counts[x], left // x), 0, -1):
                if reach[k] >> (left - times * x) & 1:
                    yield from extend(left - times * x, k, (*chosen, (x, times)), waste)

    for waste in range(min(most_waste, room - fit[0]) + 1):
        if sum(x * counts[x] for x in fit[: bisect.bisect_right(fit, waste)]) > room - waste:
            return  # whatever fits into the waste must be in the filling already
        if reach[-1] >> (room - waste) & 1:
            yield from extend(room - waste, len(fit), (), waste)


def _merge(plan: tuple) -> Plan:
    """A plan from its links (filling, times, rest)."""
    merged: dict[tuple, int] = {}
    while plan:
        filling, times, plan = plan
        merged[filling] = merged.get(filling, 0) + times
    return sorted(merged.items(), reverse=True)


def pack_lengths(hist: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, steps: int = STEPS) -> Plan:
    """Bin completion over a histogram; `nodes` and `steps` bound the search, after which the incumbent stands."""
    hist = {x: c for x, c in hist.items() if c > 0}
    if any(not 0 < x <= capacity for x in hist):
        raise ValueError("lengths lie between 1 and the capacity")
    best = best_fit(hist, capacity)
    bound, total = lower_bound(hist, capacity), sum(x * c for x, c in hist.items())
    budget = Steps(steps)

    def spare(waste: int) -> int:
        """Waste that a plan better than the incumbent may still have."""
        return (n_sequences(best) - 1) * capacity - total - waste

    def options(counts: dict[int, int], waste: int) -> Iterator[tuple[int, tuple]]:
        top = max(counts)
        rest = counts | {top: counts[top] - 1}
        return ((top, chosen) for chosen in fillings(rest, capacity - top, spare(waste), budget))

    # A depth-first search with its own stack of [counts, plan so far, sequences so far, waste so far, fillings to try, how many were tried].
    # Only the deepest `LIVE` nodes hold counts and fillings (whose tables take a megabyte or so); the others build them again on return.
    stack: list[list] = [[hist, (), 0, 0, options(hist, 0), 0]] if hist and n_sequences(best) > bound else []
    seen = 0
    while stack and seen < nodes and n_sequences(best) > bound:
        counts, plan, used, waste, todo, tried = node = stack[-1]
        if todo is None:
            node[4] = todo = itertools.islice(options(counts, waste), tried, None)
        top, chosen = next(todo, (0, ()))
        node[5] += 1
        if not top or spare(waste) < 0:
            stack.pop()
            if stack and stack[-1][0] is None:
                filling, times, _ = plan
                stack[-1][0] = counts | {x: counts.get(x, 0) + k * times for x, k in filling}
            continue
        need = dict(chosen)
        need[top] = need.get(top, 0) + 1
        times = min(counts[x] // k for x, k in need.items())
        lost = waste + (capacity - sum(x * k for x, k in need.items())) * times
        if spare(lost) < 0:
            continue
        seen += 1
        counts = {x: left for x, c in counts.items() if (left := c - need.get(x, 0) * times)}
        plan, used = (tuple(sorted(need.items(), reverse=True)), times, plan), used + times
        if not counts:
            if used < n_sequences(best):
                best = _merge(plan)
            continue
        stack.append([counts, plan, used, lost, options(counts, lost), 0])
        if len(stack) > LIVE:
            stack[-LIVE - 1][0] = stack[-LIVE - 1][4] = None
        # A dive over many lengths is too deep for the bound on nodes, so best fit completes it at some depths.
        if len(stack) & (len(stack) - 1) == 0:
            tail = best_fit(counts, capacity)
            if used + n_sequences(tail) < n_sequences(best):
                for filling, k in tail:
                    plan = (filling, k, plan)
                best = _merge(plan)
    return best


class Places:
    """Looks up (sequence, offset) by length and rank among the pieces of that length."""

    def __init__(self, plan: Plan):
        key, base, each, offset = [], [], [], []
        taken: dict[int, int] = {}
        first = 0
        for filling, times in plan:
            at = 0
            for x, k in filling:
                key.append((x << 48) | taken.get(x, 0))
                base.append(first)
                each.append(k)
                offset.append(at)
                taken[x] = taken.get(x, 0) + k * times
                at += k * x
            first += times
        order = np.argsort(np.array(key, dtype=np.int64), kind="stable")
        self.key, self.base, self.each, self.offset = (np.array(a, dtype=np.int64)[order] for a in (key, base, each, offset))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, (length << 48) | rank, side="right") - 1
        t = rank - (self.key[i] & ((1 << 48) - 1))
        return self.base[i] + t // self.each[i], self.offset[i] + (t % self.each[i]) * length


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES, salt_rows: int = SALT_ROWS, steps: int = STEPS) -> DataFrame:
    """Pieces (of a table that gives the same rows each time) with `sequence_id` and `offset`."""
    hist = {int(r[0]): int(r[1]) for r in cut_pieces.groupBy("length").count().collect()}  # `capacity` rows at most
    places = Places(pack_lengths(hist, capacity, nodes, steps))
    salts = max(16, min(1 << 16, sum(hist.values()) // salt_rows))
    salted = cut_pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id() % 4096), F.lit(salts)))
    by_salt = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_salt.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    names = cut_pieces.columns
    ranked = salted.withColumn("own", own).join(starts, ["length", "salt"])
    ranked = ranked.select(*names, (F.col("before") + F.col("own") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            seq, offset = places.find(length, rank)
            kept = [b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut_pieces.schema.fields)
    return ranked.mapInArrow(run, schema + ", sequence_id bigint, offset bigint")


def pack_documents(
    docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, nodes: int = NODES, steps: int = STEPS
) -> DataFrame:
    """The pieces of every document with `sequence_id` and `offset`; `nodes` and `steps` bound the search."""
    return pack(cut(pieces(docs, tokenizer, capacity, end_id, with_ids)), capacity, nodes, steps=steps)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
