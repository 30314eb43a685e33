import collections
import re

from rankloom.llm import collocations as C


def brute_windows(rows):
    counts = collections.Counter()
    for text, lang in rows:
        lowered = (text or "").translate(str.maketrans(C.UPPER, C.LOWER))
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lowered):
            ws = re.findall(r"[^ \t]+", piece)
            for k in range(1, 4):
                for s in range(len(ws) - k + 1):
                    counts[(lang or "und", k, " ".join(ws[s : s + k]))] += 1
    return counts


def test_chunk_counts_equal_direct_counts(edge_docs):
    got = {(r.lang, r.k, r.gram): r.f for r in C.window_counts(C.chunk_dictionary(edge_docs)).collect()}
    assert got == dict(brute_windows(edge_docs.select("text", "lang").collect()))


def test_edge_rows_and_ranking(spark, edge_docs):
    rows = C.collocations(edge_docs, min_count=2).collect()
    assert rows and {r.lang for r in rows} <= {"en", "fr", "de", "und"}
    for lang in {r.lang for r in rows}:
        mine = sorted((r for r in rows if r.lang == lang), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(mine) + 1))
        keys = [(-r.score, -r.a, r.phrase.encode()) for r in mine]
        assert keys == sorted(keys)
        for r in mine:
            assert r.score == 1_000_000 * r.a * r.a // (r.l * r.r) and r.a >= 2


def test_subsumed_pair_goes_and_ties_cut_to_shorter_first_part(spark):
    text = ". ".join(["new york city"] * 12 + ["new york"] * 3 + ["big apple pie"] * 10 + ["apple pie"] * 30)
    docs = spark.createDataFrame([(1, text, None)], "doc_id long, text string, lang string")
    got = {r.phrase: r for r in C.collocations(docs).collect()}
    assert "new york city" in got and "new york" not in got and "york city" not in got
    assert "apple pie" in got and got["big apple pie"].lang == "und"
    city = got["new york city"]
    assert (city.a, city.l, city.r, city.n) == (12, 15, 12, 3 * 12 + 2 * 3 + 3 * 10 + 2 * 30)
    assert city.score == 1_000_000 * 144 // (15 * 12)


def test_empty_and_huge_counts(spark, empty_docs):
    assert C.collocations(empty_docs).count() == 0
    big = spark.createDataFrame([(10**12, 10**12 + 1, 10**12 + 3)], "a long, l long, r long")
    score = big.select(C._exact_score("a", "l", "r").alias("s")).first().s
    assert score == 10**6 * 10**24 // ((10**12 + 1) * (10**12 + 3))


def test_key_filter_keeps_every_frequent_window_and_few_rare_ones(spark):
    frequent = [f"often{i} seen{i} here{i}" for i in range(30)] * 10
    rare = [f"rare{i} word{i} pair{i}" for i in range(3000)]
    docs = spark.createDataFrame([(i, text, "en") for i, text in enumerate(frequent + rare)], "doc_id long, text string, lang string")
    dictionary = C.chunk_dictionary(docs).cache()
    every = {(r.lang, r.k, r.gram): r.f for r in C.window_counts(dictionary).collect()}
    kept = {(r.lang, r.k, r.gram): r.f for r in C.window_counts(dictionary, keep=C.key_filter(dictionary, 10)).collect()}
    assert {w for w, f in every.items() if f >= 10} <= set(kept) and kept.items() <= every.items()
    assert len(every) == 6 * 3030 and len(kept) < len(every) / 4


def test_full_filter_and_capped_counts_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "FILTER_BYTES", 1 << 4)
    docs = spark.createDataFrame([(1, ". ".join(f"w{i} x{i}" for i in range(400) for _ in range(1 + i % 12)), "en")], "doc_id long, text string, lang string")
    got = {r.phrase: r.a for r in C.collocations(docs).collect()}
    assert got == {f"w{i} x{i}": 1 + i % 12 for i in range(400) if i % 12 >= 9}


def test_first_pass_counts_each_window_by_its_hash(spark):
    text = ". ".join(f"a{i} b{i} c{i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    dictionary = C.chunk_dictionary(docs)
    assert C.frequent_keys(dictionary, 1, 3).agg({"n": "sum"}).first()[0] == 6 * 20_000
    assert C.frequent_keys(dictionary, 2, 3).agg({"n": "sum"}).first()[0] == 0
