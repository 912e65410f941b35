import math
from collections import Counter, defaultdict
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import check

from keyloom.llm import mixing
from keyloom.llm.queries import ORACLE, QUERIES


def earliest_deadline_first(ph):
    """(source, block) of each slot, by looking at all sources in each."""
    done, out = [0] * len(ph.part), []
    for t in range(ph.length):
        ready = [(min(ph.length, -(-(j + 1) * ph.total // p)), i, j) for i, (p, j) in enumerate(zip(ph.part, done)) if j < ph.count[i] and j * ph.total // p <= t]
        due, i, j = min(ready)
        assert due > t
        done[i] += 1
        out.append((i, j))
    return out


weight = st.one_of(st.fractions(Fraction(1, 50), 9), st.floats(0.001, 50), st.sampled_from([1e-3, 1 / 3, 2 / 3, math.sqrt(2), math.sqrt(300)]))


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefg"), st.tuples(weight, st.integers(0, 60)), min_size=1), st.randoms())
def test_deviation_stays_below_one_block_of_the_given_weights(spec, random):
    given_weights = {s: w for s, (w, _) in spec.items()}
    blocks = {s: n for s, (_, n) in spec.items()}
    placed = dict.fromkeys(blocks, 0)
    for ph in mixing.phases(mixing.parts(given_weights), blocks):
        total = sum(Fraction(given_weights[s]) for s in ph.names)
        order = earliest_deadline_first(ph)
        done = [0] * len(ph.names)
        for t, (i, _) in enumerate([*order, (None, None)]):
            assert all(abs(Fraction(given_weights[s]) / total * t - n) < 1 for s, n in zip(ph.names, done))
            assert mixing.done_by(ph, t) == done
            if i is not None:
                done[i] += 1
        cut = random.randint(0, ph.length)
        got = [*mixing.slots(ph, 0, cut), *mixing.slots(ph, cut, ph.length)]
        assert got == [(ph.names[i], ph.first[i] + j, ph.start + t) for t, (i, j) in enumerate(order) if j < ph.real[i]]
        assert 2 * len(got) >= ph.length - 1
        for s, j, _ in got:
            assert j == placed[s]
            placed[s] += 1
    assert placed == blocks


def test_small_and_many_weights():
    (ph,) = mixing.phases(mixing.parts({"a": Fraction("1e-5"), "b": 1 - Fraction("1e-5")}), {"a": 10, "b": 999_990})
    at = [t for s, _, t in mixing.slots(ph, 0, ph.length) if s == "a"]
    assert len(at) == 10 and all(k * 100_000 <= t < (k + 1) * 100_000 for k, t in enumerate(at))
    third = mixing.phases(mixing.parts({"a": Fraction(1, 3), "b": Fraction(2, 3)}), {"a": 2000, "b": 4000})
    assert [(p.length, p.count) for p in third] == [(6000, (2000, 4000))]
    many = {str(i): math.sqrt(i + 1) for i in range(5000)}
    assert len(mixing.phases(mixing.parts(many), {s: int(s) + 1 for s in many})) < 20


def slots_of(rows, block):
    owner, size = {}, Counter()
    for r in rows:
        assert owner.setdefault(r.mix_slot, (r.source, r.mix_block)) == (r.source, r.mix_block)
        size[r.mix_slot] += 1
    return owner, size


def test_query_places_every_row(spark, sf):
    rows = QUERIES["op7_mix"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()
    assert Counter((r.doc_id, r.source) for r in rows) == Counter((r.doc_id, r.source) for r in docs)
    numbers = defaultdict(list)
    for r in rows:
        numbers[r.source].append(r.mix_index)
    assert all(sorted(v) == list(range(len(v))) for v in numbers.values())


def test_agrees_with_sql(spark):
    for sf in ("sf0.001", "sf0.1"):
        check(spark, QUERIES["op7_mix"], ORACLE["op7_mix"], f"/root/testdata/{sf}")


def test_prefixes_follow_weights_and_edges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    monkeypatch.setattr(mixing, "RANGE", 16)
    data = [(i if i % 5 else None, "a" if i % 3 else None, str(i)) for i in range(900)] + [(5, "b", "dup")] * 300
    df = spark.createDataFrame(data, "doc_id long, source string, mix_slot string")
    weights = {"a": 0.5, None: 0.25, "b": 0.25}
    rows = mixing.schedule(df, weights, block=4).collect()
    assert len(rows) == len(data)
    owner, _ = slots_of(rows, 4)
    done = Counter()
    for t in range(200):
        for s, w in weights.items():
            assert abs(w * t - done[s]) < 1
        done[owner[t][0]] += 1
    assert mixing.schedule(df.limit(0)).count() == 0
    assert [r.mix_slot for r in mixing.in_order(mixing.schedule(df, block=4)).collect()] == sorted(r.mix_slot for r in mixing.schedule(df, block=4).collect())


def test_numbers_in_a_source_do_not_depend_on_others(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    a = [(i, "a") for i in range(60)]
    index = lambda rows: {r.doc_id: r.mix_index for r in mixing.schedule(spark.createDataFrame(rows, "doc_id long, source string")).collect() if r.source == "a"}
    assert index(a) == index(a + [(i, "b") for i in range(700)])
