import math
import os

import pytest

from propgraph.llm import mixing as m

DOCS = "doc_id bigint, source string, text string, n_tokens string"
LISTED = "source string, target_share double, max_repeats int, n int"


def test_targets_are_met_at_the_largest_size():
    shares = m.plan([("a", 100, 0.5, 2), ("b", 1000, 0.3, 1), ("c", 50, 0.2, 3), ("none", 0, 0.5, 3), ("zero", 9, 0.0, 1)])
    assert [s.source for s in shares] == ["a", "b", "c"] and [round(s.weight, 12) for s in shares] == [0.5, 0.3, 0.2]
    size = sum(s.budget for s in shares)
    assert math.isclose(size, 400) and all(s.budget <= s.tokens * s.repeats * (1 + 1e-9) for s in shares)


def test_size_and_repetition_limit():
    sources = [("a", 100, 0.5, 2), ("b", 1000, 0.3, 1), ("c", 50, 0.2, 3)]
    shares = m.plan(sources, size=800)
    assert math.isclose(sum(s.budget for s in shares), 800, rel_tol=1e-6)
    assert all(s.budget <= s.tokens * s.repeats * (1 + 1e-6) for s in shares)
    # no smaller exponent would do: a limit is reached
    assert any(math.isclose(s.budget, s.tokens * s.repeats, rel_tol=1e-6) for s in shares)
    assert sum(s.budget for s in m.plan(sources, size=10**9)) <= 1150 * 1.001


def test_entropy():
    sources = [("a", 10, 0.5, 9), ("b", 1000, 0.5, 9)]
    want = 0.4
    assert math.isclose(m.entropy([s.weight for s in m.plan(sources, target_entropy=want)]), want, rel_tol=1e-6)


def test_tempering_exponentiates_own_shares():
    sources = [("a", 10, 0.5, 9), ("b", 1000, 0.5, 9), ("c", 100, None, 9)]
    p = [10 / 1110, 1000 / 1110, 100 / 1110]
    natural = m.temper(sources)
    assert [round(s.weight, 12) for s in natural] == [round(x, 12) for x in p]
    for want in (0.6, 0.9, 1.05):
        shares = m.temper(sources, target_entropy=want)
        w = [s.weight for s in shares]
        assert math.isclose(m.entropy(w), want, rel_tol=1e-6)
        # one exponent for all: log weights are in proportion to log shares
        a = [(math.log(w[i]) - math.log(w[0])) / (math.log(p[i]) - math.log(p[0])) for i in (1, 2)]
        assert math.isclose(*a, rel_tol=1e-6) and 0 < a[0] < 1
        assert all(s.budget <= s.tokens * s.repeats * (1 + 1e-9) for s in shares)
    assert [round(s.weight, 9) for s in m.temper(sources, target_entropy=9.0)] == [round(1 / 3, 9)] * 3


def test_tempering_to_repetition_limits():
    sources = [("a", 10, 0.5, 4), ("b", 1000, 0.5, 1), ("c", 100, 0.1, 2)]
    shares = m.temper(sources, size=1110)
    assert math.isclose(sum(s.budget for s in shares), 1110, rel_tol=1e-6)
    assert all(s.budget <= s.tokens * s.repeats * (1 + 1e-6) for s in shares) and any(math.isclose(s.budget, s.tokens * s.repeats, rel_tol=1e-6) for s in shares)
    assert m.temper([("a", 0, 1.0, 1), ("b", 5, 1.0, None)]) == []


def test_selection_does_not_depend_on_other_sources(spark):
    data = [(i, "a", 1 + i % 5) for i in range(500)]
    counts = spark.createDataFrame(data, "doc_id bigint, source string, n_tokens bigint")
    one = m.Share("a", sum(x[2] for x in data), 1.0, 1, 1.0, 400.0)
    many = [one, *(m.Share(f"s{i}", 10, 0.1, 1, 0.1, 5.0) for i in range(300))]
    assert sorted(map(tuple, m.realise(counts, [one]).collect())) == sorted(map(tuple, m.realise(counts, many).collect()))


def test_order(spark):
    mix = spark.createDataFrame([(i, "a", 3, 1 + i % 2) for i in range(200)], "doc_id bigint, source string, n_tokens bigint, copies int")
    rows = m.permuted(mix).collect()
    first, second = ([r.doc_id for r in sorted(rows, key=lambda r: r.place) if r.pass_no == n and r.doc_id % 2] for n in (0, 1))
    assert len(rows) == 300 and sorted(first) == sorted(second) and first != second


def test_nothing_to_mix():
    assert m.plan([]) == [] and m.plan([("a", 0, 1.0, 1)]) == [] and m.plan([("a", 5, None, 1), ("b", 5, 0.1, None)]) == []


def test_realised_budgets(spark):
    data = [(i, "ab"[i % 3 == 0], 1 + i % 7) for i in range(900)] + [(10_000, "other", 50), (10_001, None, 50)]
    counts = spark.createDataFrame(data, "doc_id bigint, source string, n_tokens bigint")
    listed = [("a", sum(n for _, s, n in data if s == "a"), 0.1, 1), ("b", sum(n for _, s, n in data if s == "b"), 0.9, 3)]
    for bits in (1, 4, 12):
        shares = m.plan(listed)
        mix = m.realise(counts, shares, bits=bits)
        rows = mix.collect()
        assert len({r.doc_id for r in rows}) == len(rows) and all(1 <= r.copies <= (3 if r.source == "b" else 1) for r in rows)
        for s in shares:
            used = [r for r in rows if r.source == s.source]
            assert abs(sum(r.n_tokens * r.copies for r in used) - s.budget) <= 4
            assert max(r.copies for r in used) - min(r.copies for r in used) <= 1
    one, two = (sorted(map(tuple, m.realise(counts, shares, seed).collect())) for seed in (1, 2))
    assert one == sorted(map(tuple, m.realise(counts, shares, 1).repartition(7).collect())) and one != two
    copies = m.permuted(mix)
    assert copies.count() == sum(r.copies for r in rows)


@pytest.mark.skipif(not os.path.exists(m.TOKENIZER), reason="no tokenizer files")
def test_over_tables(spark):
    text = "The harness is on the table. "
    docs = [(1, " Fan-Upload ", text, None), (2, "fan_upload", text * 3, None), (3, "FAN UPLOAD", "", None), (4, None, text, None), (5, "other", text, None), (6, "radio", text, None), (6, "radio", text, None), (7, "radio", None, None), (8, "radio", "é" * 100_000, None)]
    d = spark.createDataFrame(docs, DOCS)
    listed = spark.createDataFrame([("fan_upload", 0.5, 2, 0), ("radio", 0.5, 1, 0), ("ghost", 0.2, 2, 0), (None, 0.1, 1, 0)], LISTED)
    counts = m.count_tokens(d)
    by = {r.doc_id: (r.source, r.n_tokens) for r in counts.collect()}
    assert by[1][0] == by[2][0] == "fan_upload" and by[2][1] == 3 * by[1][1] - (by[1][1] * 3 - by[2][1]) and 3 not in by and 7 not in by
    mix = m.realise(counts, m.plan(m.listed_totals(counts, listed)))
    report = {r.source: r for r in m.shares_reached(counts, mix, listed).collect()}
    assert set(report) == {"fan_upload", "radio", "ghost", "other", None}
    assert report["ghost"].mixed_tokens == 0 and report["other"].share_reached == 0 and report[None].target_share is None
    assert math.isclose(sum(r.share_reached for r in report.values()), 1)
    empty = m.count_tokens(d.limit(0))
    assert m.realise(empty, m.plan(m.listed_totals(empty, listed))).count() == 0


@pytest.mark.skipif(not os.path.exists(m.TOKENIZER), reason="no tokenizer files")
def test_token_round_trip():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(m.TOKENIZER, "rb"))}
    e = tiktoken.Encoding("x", pat_str=m.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in ("Hello, <|endoftext|> wörld  \n 123", "日本語 ", "\x00"):
        assert e.decode(e.encode_ordinary(t)) == t
