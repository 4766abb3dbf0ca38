"""Tokenizer, packing and shared spans against references, round trips and brute force."""

import random

import numpy as np
import pytest
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weir.llm import spans as S
from weir.llm.bits import may_have_partner
from weir.llm.bpe import PATTERN, Encoded, Vocabulary, read_ranks
from weir.llm.packing import histogram_of, items_of, length_buckets, pack, plan_batches, plan_containers
from weir.llm.tokenize import rank_file, with_ids, with_token_count
from weir.scratch import Scratch

DATA = open(rank_file(), "rb").read()
RANKS = read_ranks(DATA)
VOCABULARY = Vocabulary(RANKS)
REFERENCE = tiktoken.Encoding("reference", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["", " ", "  x", "a  b", "a   b", " \n x", "x \n", "\x1c \x1d a", "  a b", "don't 're 'S", "世界" * 50, "é🙂👩‍👩‍👧", "a" * 3000, " " * 700, "\t\r\n\v", "½²³ Ⅷ", "ﷺ‏‮", "﻿x", "a\u0000b", "1234567890" * 20]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert VOCABULARY.encode(text) == REFERENCE.encode_ordinary(text)
    assert VOCABULARY.decode(VOCABULARY.encode(text)) == text


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'aeinorst.,-0123"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_any_text(text):
    assert VOCABULARY.encode(text) == REFERENCE.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 8), st.text(alphabet=" \n'aresvl1.é世", max_size=6)), max_size=8))
def test_appends_and_edits_equal_encoding_anew(edits):
    text = Encoded(VOCABULARY, "it's  all we've\n here 12")
    for start, length, new in edits:
        start = min(start, len(text.text))
        text.replace(start, min(len(text.text), start + length), new)
        text.append(new)
        assert text.ids() == REFERENCE.encode_ordinary(text.text)


def test_edits_cost_what_is_near():
    text = Encoded(VOCABULARY, "some ordinary words of text " * 4000)
    before = text.encoded_bytes
    text.replace(50_000, 50_003, "xyz")
    text.append(" tail")
    assert text.encoded_bytes - before < 200
    assert text.ids() == REFERENCE.encode_ordinary(text.text)
    run = Encoded(VOCABULARY, "a" * 50_000)
    before = run.encoded_bytes
    run.append("aaa")
    assert run.encoded_bytes - before == 3


def test_memory_of_words_changes_nothing(monkeypatch):
    monkeypatch.setattr("weir.llm.bpe.MEMO_ENTRIES", 3)
    small, text = Vocabulary(RANKS), "one two three four five one two six'll  seven " * 20
    assert small.encode(text) == REFERENCE.encode_ordinary(text)
    assert len(small.words) <= 4


def test_columns_of_ids(spark):
    rows = [(1, t, "x") for t in ODD] + [(2, None, "y"), (2, None, "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").withColumn("__text", F.lit(1))
    got = with_ids(df).collect()
    assert [list(r.ids) for r in got] == [REFERENCE.encode_ordinary(t or "") for _, t, _ in rows]
    assert [r.n_tokens for r in with_token_count(df).collect()] == [len(r.ids) for r in got]
    assert with_ids(df.limit(0)).count() == 0
    assert dict(with_ids(df).dtypes) == {"doc_id": "bigint", "__text": "int", "ids": "array<int>"}


def test_least_padding_by_brute_force():
    from itertools import combinations

    rng = np.random.default_rng(0)
    for _ in range(60):
        histogram = np.zeros(14, int)
        histogram[1:] = rng.integers(0, 6, 13) * (rng.random(13) < 0.7)
        used = np.flatnonzero(histogram)
        for k in (1, 2, 3):
            padding = lambda bounds: sum(histogram[n] * (min(b for b in bounds if b >= n) - n) for n in used)
            got = length_buckets(histogram, k)
            assert len(got) <= k
            if len(used):
                assert padding(got) == min(padding((*c, used[-1])) for c in combinations(used[:-1], min(k, len(used)) - 1))


@pytest.mark.parametrize("close", [True, False])
def test_plan_holds_every_item_once(close):
    rng = np.random.default_rng(1)
    for capacity in (1, 7, 64):
        histogram = np.concatenate([[0], rng.integers(0, 40, capacity)])
        runs, made = plan_containers(histogram, capacity, length_buckets(histogram, 5), close)
        used = np.zeros(made, int)
        for length in range(1, capacity + 1):
            own = runs[runs[:, 0] == length]
            ends = [*own[1:, 1], histogram[length]]
            for (_, first, container, each, _), end in zip(own, ends):
                for rank in range(first, end):
                    used[container + (rank - first) // each] += length
        assert used.max(initial=0) <= capacity and used.sum() == (histogram * np.arange(capacity + 1)).sum()


def test_batches_form_inside_their_buckets():
    histogram = np.zeros(101, int)
    histogram[[60, 40, 30, 9, 1]] = [10, 8, 20, 3, 50]
    bounds = [30, 40, 100]
    inside = plan_batches(histogram, 100, bounds, close=False)
    low = dict(zip(bounds, [0, *bounds]))
    assert all(low[bound] < n <= bound for content, _, bound in inside for n in content)
    closed = plan_batches(histogram, 100, bounds)
    # 60s leave 40 and 40s leave 20: the shortest bucket holds as much and fills it, the 40s stay together
    assert {(60, bound) for content, _, bound in closed if 60 in content} == {(60, 100)}
    assert sum(times for content, times, _ in closed if content.get(40) == 2) == 4
    assert sum(times for _, times, _ in closed) < sum(times for _, times, _ in inside)
    assert plan_batches(np.zeros(5, int), 4, []) == []


def packed(spark, lengths, capacity):
    df = spark.createDataFrame(lengths, "k string, n int").withColumn("rank", F.lit("clash")).withColumn("size", F.lit("clash"))
    items = Scratch(spark, "test").keep(items_of(df, "k", "n", capacity))
    return pack(items, "k", capacity).collect()


def test_packing_rows(spark):
    rng = random.Random(2)
    lengths = [(f"d{i}", rng.choice([0, 1, 5, 60, rng.randrange(1, 300)])) for i in range(900)] + [("null", None), ("long", 100_000), ("twice", 7), ("twice", 7)]
    rows = packed(spark, lengths, 64)
    used, parts = {}, {}
    for r in rows:
        used[r.container_id] = used.get(r.container_id, 0) + r["size"]
        parts.setdefault(r.k, []).append((r.part, r.start, r["size"]))
        assert r.bucket >= r["size"]
    assert max(used.values()) <= 64 and sorted(used) == list(range(len(used)))
    assert sum(used.values()) / len(used) / 64 > 0.98
    for k, n in lengths:
        own = sorted(parts.get(k, []))
        if k == "twice":
            assert own == [(0, 0, 7), (0, 0, 7)]
        else:
            assert [p for p, _, _ in own] == list(range(-(-(n or 0) // 64))) and sum(s for _, _, s in own) == (n or 0)
            assert all(start == p * 64 for p, start, _ in own)
    assert packed(spark, [], 64) == [] == packed(spark, [("a", 0), ("b", None)], 64)
    assert {r.container_id for r in packed(spark, [("a", 64)] * 50, 64)} == set(range(50))


def test_histogram_is_bounded(spark):
    items = spark.range(5000).select(F.lit(3).alias("size"))
    assert histogram_of(items, 8).tolist() == [0, 0, 0, 5000, 0, 0, 0, 0, 0]


def shared_by_brute_force(texts, span):
    where = {}
    for i, t in texts:
        for a in range(len(t or "") - span + 1):
            where.setdefault(t[a : a + span], set()).add(i)
    out = {}
    for i, t in texts:
        on = set()
        for a in range(len(t or "") - span + 1):
            if len(where[t[a : a + span]]) > 1:
                on.update(range(a, a + span))
        if on:
            out[i] = max(len(on), out.get(i, 0))
    return out


def shared(spark, texts, span, batches=1, fan_out=4):
    df = spark.createDataFrame(texts, "id bigint, t string").withColumn("doc", F.lit("clash")).withColumn("h", F.lit(1))
    index = S.SpanIndex(Scratch(spark, "test"), span=span, fan_out=fan_out)
    for b in range(batches):
        index.append(df.filter(F.pmod("id", F.lit(batches)) == b), "id", "t", df)
    rows = index.shared().collect()
    tables = len(index.tables)
    index.drop()
    return {r.doc: r.shared_chars for r in rows}, tables


def corpus(rng, n, alphabet="abcdefgh é世🙂"):
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    common = [word(k) for k in (19, 20, 21, 40, 77)]
    texts = []
    for i in range(n):
        parts = [word(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 3)):
            c = rng.choice(common)
            a = rng.randrange(0, 4)
            parts += [c[a : len(c) - rng.randrange(0, 4)], word(rng.randrange(0, 30))]
        texts.append((i, "".join(parts)))
    return texts + [(900, None), (901, ""), (902, common[4]), (903, common[4] + common[4]), (904, "z" * 100), (905, "z" * 60), (906, "y" * 100)]


@pytest.mark.parametrize("span", [2, 3, 20])
def test_shared_spans_like_brute_force(spark, span):
    texts = corpus(random.Random(span), 60)
    assert shared(spark, texts, span)[0] == shared_by_brute_force(texts, span)


def test_shared_spans_in_batches_with_compaction(spark):
    texts = corpus(random.Random(9), 80)
    got, tables = shared(spark, texts, 20, batches=5, fan_out=2)
    assert got == shared_by_brute_force(texts, 20) and tables <= 3


def test_shared_spans_edges(spark):
    assert shared(spark, [], 20)[0] == {}
    assert shared(spark, [(1, None), (2, "short")], 20)[0] == {}
    alone = "abcdefghijklmnopqrstuvwxyz" * 3
    assert shared(spark, [(1, alone), (1, alone)], 20)[0] == {}, "a repeated row isn't another record"
    assert shared(spark, [(1, alone), (2, alone), (3, alone)], 20)[0] == {1: 78, 2: 78, 3: 78}


def test_long_texts_are_sliced(monkeypatch):
    monkeypatch.setattr(S, "SLICE", 64)
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab ") for _ in range(n)) for n in (500, 10, 63, 64, 65, 0, 130)]
    windows = sorted((int(r), w) for part in S.runs_of(texts, 16) for r, a, b in zip(part[0], part[2], part[3]) for w in range(int(a), int(b) + 1))
    assert windows == sorted((i, w) for i, t in enumerate(texts) for w in range(len(t) - 15))


def test_equal_windows_have_equal_anchors():
    rng = random.Random(6)
    piece = "".join(rng.choice("abcd") for _ in range(40))
    anchors = []
    for lead in ("", "xyz" * 9):
        for _, h, a, b, p in ((*r,) for part in S.runs_of([lead + piece + "tail" * 8], 40) for r in zip(*part)):
            if a <= len(lead) <= b:
                anchors.append((int(h), int(p) - len(lead)))
    assert len(anchors) == 2 and anchors[0] == anchors[1]


def test_filter_never_loses_a_partner(spark):
    df = spark.range(5000)
    partners = spark.range(0, 5000, 7).select(F.col("id").alias("p"))
    assert {r.id for r in may_have_partner(df, "id", partners, "p", 10**6).collect()} >= set(range(0, 5000, 7))
    kept = {r.id for r in may_have_partner(df, "id", partners, "p").collect()}
    assert kept >= set(range(0, 5000, 7)) and len(kept) < 760
    assert may_have_partner(df, "id", partners.limit(0), "p").count() == 0
