import random
import zlib
from collections import Counter

import fixtures as X
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corrweave.llm import packing as P


def expected_pieces(rows, capacity):
    tok = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    out = []
    for doc_id, text, *_ in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, P.END_ID]
        for k in range(0, len(ids), capacity):
            part = np.array(ids[k : k + capacity], dtype="<u4")
            out.append((doc_id, k // capacity, k, len(part), zlib.crc32(part.tobytes())))
    return out


def check_places(rows, capacity):
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq)


@pytest.mark.parametrize("capacity", [16, 4096])
def test_pack_documents(spark, capacity):
    rows = P.pack_documents(X.documents(spark, length=1, sequence_id="x"), capacity=capacity).collect()
    assert X.same([tuple(r)[:5] for r in rows], expected_pieces(X.ROWS, capacity))
    n = check_places(rows, capacity)
    assert n == P.lower_bound(Counter(r["length"] for r in rows), capacity)


def test_ids_and_empty(spark):
    rows = P.pieces(X.documents(spark), capacity=16, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in rows)
    assert P.pack_documents(X.documents(spark).filter("doc_id < 0")).count() == 0


def test_encoder_equals_tokenizer(monkeypatch):
    path = public_tokenizers.path(P.TOKENIZER)
    tok, enc = Tokenizer.from_file(path), P.WordEncoder(path, most=5)  # a store that starts anew all the time
    rnd = random.Random(4)
    letters = "abcXYZ ÉéßıİΣσς'’.,!|0123 \t\n  ñ中文\U0001f600é"
    for _ in range(300):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
        assert enc.encode(text).tolist() == tok.encode(text, add_special_tokens=False).ids, text


def best(items, capacity):
    least = [len(items)]

    def place(i, rooms):
        if len(rooms) >= least[0]:
            return
        if i == len(items):
            least[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= items[i] and rooms[j] not in rooms[:j]:
                place(i + 1, [*rooms[:j], rooms[j] - items[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return least[0]


def check_plan(plan, hist, capacity):
    used = Counter()
    for filling, times in plan:
        assert sum(x * k for x, k in filling) <= capacity
        for x, k in filling:
            used[x] += k * times
    assert used == Counter(hist)


def test_bin_completion_is_optimal_on_small_cases():
    for seed in range(400):
        rnd = random.Random(seed)
        capacity = rnd.choice([10, 20, 50])
        hist = Counter(rnd.randint(1, capacity) for _ in range(rnd.randint(0, 9)))
        plan = P.pack_lengths(hist, capacity)
        check_plan(plan, hist, capacity)
        items = sorted(hist.elements(), reverse=True)
        assert P.lower_bound(hist, capacity) <= best(items, capacity) == P.n_sequences(plan)


def test_search_beats_best_fit():
    hist = {6: 1, 5: 1, 4: 2, 3: 3, 2: 1}  # 30 in three sequences of ten
    for _ in range(3):
        assert P.n_sequences(P.pack_lengths(hist, 10)) == 3
    found = 0
    for seed in range(3000):
        rnd = random.Random(seed)
        hist = Counter(rnd.randint(15, 60) for _ in range(14))
        a, b = P.n_sequences(P.best_fit(hist, 100)), P.n_sequences(P.pack_lengths(hist, 100))
        assert b <= a
        found += b < a
    assert found


def plain_fillings(lengths, room):
    """By definition: of all subsets of single lengths, those that no remaining length can enter or replace a part of."""
    found = [()]
    for x in sorted(lengths, reverse=True):
        found += [(*f, x) for f in found if sum(f) + x <= room]
    out = set()
    for f in found:
        waste, rest = room - sum(f), [x for x in lengths if x not in f]
        parts = {0}
        for x in f:
            parts |= {p + x for p in parts}
        if not any(p <= x <= p + waste for x in rest for p in parts):
            out.add(f)
    return out


@pytest.mark.parametrize(("lengths", "room"), [(range(1, 14), 20), (range(1, 60, 7), 100), ([2, 3, 5, 8, 9, 13, 21, 22], 30), ([50], 40), ([5, 6], 30)])
def test_fillings_are_the_undominated_ones(lengths, room):
    found = list(P.fillings(dict.fromkeys(lengths, 1), room))
    got = {tuple(x for x, k in f for _ in range(k)) for f in found}
    assert len(got) == len(found) and got == plain_fillings([x for x in lengths if x <= room], room)
    waste = [room - sum(x * k for x, k in f) for f in found]
    assert waste == sorted(waste)


def test_fillings_of_many_lengths():
    found = [tuple(x for x, k in f for _ in range(k)) for f in P.fillings(dict.fromkeys(range(1, 60), 1), 100)]
    assert {(x, 100 - x) for x in range(51, 60)} <= set(found) and (40, 39, 21) in found and not any(sum(f) < 100 for f in found)
    assert list(P.fillings({3: 10**9, 1: 10**9}, 4096)) == [((3, 1365), (1, 1))]
    assert list(P.fillings({1: 10}, 4096)) == [((1, 10),)]
    steps = P.Steps(50)
    assert len(list(P.fillings(dict.fromkeys(range(1, 400), 1), 4096, steps=steps))) < 50 and steps.left < 0


def test_triplets():
    """Exact-fit triplets are best fit's worst case: the search closes all of the gap or all but one sequence."""
    for seed in range(5):
        rnd = random.Random(seed)
        hist = Counter()
        for _ in range(20):
            a = rnd.randint(1556, 2007)
            b = rnd.randint(1024, (4096 - a) // 2)
            hist.update([a, b, 4096 - a - b])
        plan = P.pack_lengths(hist)
        check_plan(plan, hist, 4096)
        assert P.n_sequences(plan) == 20 and P.n_sequences(P.best_fit(hist, 4096)) >= 23


def test_query_keeps_special_tokens(spark, tmp_path):
    rows = [*X.ROWS, (21, "hi <|endoftext|> there<|startoftext|>", "en", "a"), (22, "<|EndOfText|>", "en", "a"), (23, "Word " * 300_000, "en", "a"), *[(24, "same", "en", "a")] * 500, *[(None, "same", "en", "a")] * 500]
    X.documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    df = P.op1_best_fit_packing(spark, str(tmp_path))
    assert df.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = df.collect()
    assert X.same([tuple(r)[:5] for r in got], expected_pieces(rows, 4096))
    n = check_places(got, 4096)
    assert n == P.lower_bound(Counter(r["length"] for r in got), 4096)
    ids = P.encoder(public_tokenizers.path(P.TOKENIZER)).encode("hi <|endoftext|> there").tolist()
    assert ids == [1883, 49407, 997]


def test_stores_are_bounded_by_bytes():
    path = public_tokenizers.path(P.TOKENIZER)
    tok, enc = Tokenizer.from_file(path), P.WordEncoder(path, most_bytes=2000)
    for i in range(60):
        text = f"{'x' * (i * 7 % 90)}{i} {'yz' * 40}{i}, plain words"
        assert enc.encode(text).tolist() == tok.encode(text, add_special_tokens=False).ids
        assert enc.word_bytes < 3000 and enc.part_bytes < 3000


def test_large_histograms_stay_cheap():
    rnd = random.Random(0)
    hist = Counter(min(4096, int(rnd.lognormvariate(6, 1.2)) + 1) for _ in range(20_000))
    hist[1500] += 10**9
    plan = P.pack_lengths(hist)
    check_plan(plan, hist, 4096)
    assert P.n_sequences(plan) <= 1.001 * 10**9 / 2 and len(plan) < 20_000  # two of 1500 fit a sequence, three don't
