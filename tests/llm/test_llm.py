import random

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.llm import answer_defects, cross_split, cut_texts, layout_copies, leak, mixture, reading_level, stands
from loomwright.llm.crf import CRF, hashed
from loomwright.llm.fm_index import FMIndex
from loomwright.llm.layout import request_key, statement_key
from loomwright.llm.plain import codes, tokens
from loomwright.llm.request import Values


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=30), max_size=6), st.lists(st.integers(0, 4), min_size=1, max_size=4), st.sampled_from([1, 4, 16]))
def test_fm_index_finds_all_and_only_occurrences(texts, pattern, step):
    arrays = [np.array(t, np.int64) for t in texts]
    f = FMIndex(arrays, step)
    lo, hi = f.search(f.encode(np.array(pattern)).reshape(1, -1))
    t, off = f.text_of(f.locate(np.arange(lo[0], hi[0])))
    w = len(pattern)
    assert sorted(zip(t.tolist(), off.tolist())) == sorted((i, j) for i, x in enumerate(texts) for j in range(len(x) - w + 1) if x[j : j + w] == pattern)


def test_maximal_matches_are_matches():
    rng = random.Random(3)
    texts = [np.array([rng.randrange(3) for _ in range(50)]) for _ in range(4)]
    f = FMIndex(texts)
    q = [np.array([rng.randrange(4) for _ in range(30)]) for _ in range(6)]
    t, s, n, lo, hi = f.maximal_matches([f.encode(x) for x in q], 1)
    for a, b, c, d, e in zip(t, s, n, lo, hi):
        i, j = f.text_of(f.locate(np.arange(d, e)))
        assert all((texts[x][y : y + c] == q[a][b : b + c]).all() for x, y in zip(i, j)) and e > d


def keys(spark, make, texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, text string, _other string")
    return {r.id: r.key for r in make(df, "text", "key").collect()}


def test_request_keys(spark):
    k = keys(spark, request_key, ["期间=2024年7月；服务=驿站达；单票千克=>=7.5", "- 服务: 驿站达 / 单票千克: >=７.５ / 期间: 2024 年 7 月.", "期间=2024年7月；服务=驿站达；单票千克=>=75", "期间=2024年7月；服务=驿站达；单票千克=<7.5", "Keep two decimals.", "**KEEP  two\tdecimals**", "Keep two decimal", None, " \n ", "x" * 100_000])
    assert k[0] == k[1] and len({k[0], k[2], k[3]}) == 3
    two = keys(spark, request_key, ["period=2024-07;service=locker", "Service: locker / period = 2024-07", "period=2024-07;service=lockers", "periods=2024-07;ervice=locker"])
    assert two[0] == two[1] and len({two[0], two[2], two[3]}) == 3
    assert k[4] == k[5] != k[6] and k[7] is None and k[8] == "" and len(k[9]) == 100_000


def test_statement_keys(spark):
    k = keys(spark, statement_key, ["SELECT a.x AS c, ROUND(100.0 * SUM(b) / COUNT(*), 2) AS v FROM t WHERE k >= 7.5", "select round( 100.0 * sum(b) / count( * ), 2 ) as v,a.[x] as c\r\n from t where k>=7.5;", "SELECT a.x AS c, ROUND(100.0 * SUM(b) / COUNT(*), 2) AS v FROM t WHERE k < 7.5", "SELECT a.x AS c, ROUND(100.0 * SUM(b) / COUNT(*), 3) AS v FROM t WHERE k >= 7.5", "SELECT a.x AS d, ROUND(100.0 * SUM(b) / COUNT(*), 2) AS v FROM t WHERE k >= 7.5", None])
    assert k[0] == k[1] and len({k[0], k[2], k[3], k[4]}) == 4 and k[5] is None
    deep = "f(" * 9 + "a, b" + ")" * 9
    k = keys(spark, statement_key, [f"SELECT {deep} AS x, c FROM t", f"select c, {deep} as x from t", f"SELECT {deep.replace('a, b', 'b, a')} AS x, c FROM t", "SELECT (a, b FROM t", "", "SELECT " + "a, " * 5000 + "b FROM t"])
    assert k[0] == k[1] != k[2] and k[3] is not None and k[5] is not None


def test_copies_with_and_without_hot_keys(spark):
    rng = random.Random(1)
    data = [("task", i, 7 if i % 3 == 0 else rng.randrange(40), 0) for i in range(600)] + [("task", 5, 7, 0), ("task", 5, 7, 0)]
    df = spark.createDataFrame(data, "table_name string, id long, k1 long, k2 long").repartition(5)
    want = set()
    groups = {}
    for _, i, k, _ in data:
        groups.setdefault(k, set()).add(i)
    for g in groups.values():
        want |= {(min(g), x) for x in g if x != min(g)}
    for hot in (10**9, 50):
        assert {(r.id_low, r.id_high) for r in layout_copies.copies(df, hot).collect()} == want
        sets = layout_copies.copy_sets(df, hot)
        assert {r.k1: r.n_copies for r in sets.collect()} == {k: len(g) for k, g in groups.items()}
    assert layout_copies.copies(df.limit(0)).count() == 0


BASE = "Please find the total weight. Scope: wave BC004-182-928, June 2024, locker, withdrawn, single weight at least 18 kg. The briefing still lacks one line."


def _asks(spark, asks):
    """Records of the asks and of others with statements, from which values are learnt; (overlaps, report, classes)."""
    rng = random.Random(8)
    rows = []
    for i in range(400):
        service, bound, metric, month = rng.choice(["locker", "bulky", "rush"]), rng.choice([("at least", ">="), ("no less than", ">="), ("below", "<"), ("under", "<")]), rng.choice([("total weight", "SUM(weight_kg)"), ("summed weight", "SUM(weight_kg)"), ("shipment count", "COUNT(*)")]), rng.choice(["June", "July"])
        q = f"Please find the {metric[0]}. Scope: wave BC{rng.randrange(100, 999)}-{rng.randrange(100, 999)}-{rng.randrange(100, 999)}, {month} 2024, {service}, withdrawn, single weight {bound[0]} {rng.choice([18, 25, 40])} kg. {rng.choice(['The briefing still lacks one line.', 'Keep two decimals.', ''])}"
        sql = f"SELECT {metric[1]} AS value FROM s WHERE s.day >= '2024-{month}' AND s.service = '{service}' AND s.weight_kg {bound[1]} 18"
        rows.append((1000 + i, [("user", q)], ("tr",), ((sql,),), 1))
    rows += [(i, [("user", t)] if t is not None else None, (s,), ((None,),), 1) for i, (s, t) in asks.items()]
    rec = spark.createDataFrame(rows, "record_id long, prompt array<struct<role string, content string>>, extra_info struct<source_label string>, reward_model struct<ground_truth struct<verification_sql string>>, split int")
    src = spark.createDataFrame([("tr", "train"), ("va", "val"), ("te", "test"), (None, "train")], "label string, split string")
    q = cross_split.questions(rec, src).cache()
    pairs = cross_split.class_pairs(q, cross_split.learnt(rec)).cache()
    return {(r.train_id, r.eval_id) for r in cross_split.overlaps(q, pairs).collect()}, cross_split.report(q, pairs).collect(), q


def test_cross_split(spark):
    asks = {
        1: ("tr", BASE), 2: ("va", "Workspace: x.\n\nTask: " + BASE.upper()), 3: ("va", BASE.replace("at least", "no less than").replace("briefing", "breifing")), 4: ("te", BASE.replace("18 kg", "1.8 kg")), 5: ("te", BASE.replace("locker", "bulky")),
        6: ("te", BASE.replace("total weight", "shipment count")), 7: ("tr", BASE.replace("The briefing still lacks one line.", "Keep two decimals.")), 8: ("va", ""), 9: ("zz", BASE), 10: ("va", None), 11: ("te", BASE.replace("at least", "below")),
        12: ("te", "Workspace: " + "long notice " * 100 + ".\nTask: " + BASE + " The briefing mentions 3 lines."), 13: ("te", BASE.replace("June", "July")), 14: ("va", "x " * 60_000),
    }
    got, report, q = _asks(spark, asks)
    assert got == {(a, e) for a in (1, 7) for e in (2, 3, 12)}
    assert {(r.eval_split, r.pairs, r.eval_records, r.train_records) for r in report} == {("val", 4, 2, 2), ("test", 2, 1, 2)}
    assert cross_split.class_pairs(q.limit(0), Values([])).count() == 0


def test_cross_split_beyond_the_vocabulary(spark):
    ask = "What is the {} of the country with the longest coastline in the southern half of the world?"
    asks = {
        1: ("tr", ask.format("capital city")), 2: ("te", ask.format("tallest mountain")), 3: ("te", ask.format("capitol city")), 4: ("va", ask.format("capital city") + " Kindly answer within one short line."), 5: ("va", ask.format("capital city").replace("southern", "northern")),
        6: ("tr", "城市里最老的桥是哪一年修的，请说明出处"), 7: ("te", "城市里最老的桥是哪一年修的。请说明出处！"), 8: ("te", "城市里最新的桥是哪一年修的，请说明出处"),
    }
    assert _asks(spark, asks)[0] == {(1, 3), (1, 4), (6, 7)}


def test_cross_split_of_a_split_bucket(spark, monkeypatch):
    asks = {i: ("tr" if i % 2 else "te", BASE + " Line" + " one" * (i % 5) + "." * i) for i in range(1, 13)}
    whole = _asks(spark, asks)[0]
    monkeypatch.setattr(cross_split, "BUCKET_ROWS", 2)
    assert _asks(spark, asks)[0] == whole and len(whole) == 36


def _stated(n):
    """(question, statement) of n requests in which words tell the region and the figure; some have no region."""
    rng = random.Random(11)
    out = []
    for i in range(n):
        region, figure, more = rng.choice(["north", "south", "west"]), rng.choice([("how much", "SUM(x)"), ("how many", "COUNT(*)"), ("what mean", "AVG(x)")]), rng.choice(["", "in short", "by name please"])
        told = f"up {region}" if rng.random() < 0.97 else "down there"  # a twentieth of the requests may say otherwise
        where = f" WHERE region = '{region}' AND x > {rng.randrange(9)}" if i % 7 else ""
        out.append((f"{figure[0]} {told} code QZ{rng.randrange(10, 99)} {more}" if i % 50 else "?", f"SELECT {figure[1]} AS value FROM t{where}"))
    return out


def test_words_are_learnt_from_every_request(spark, monkeypatch):
    asks = _stated(900)
    whole = Values(asks)
    monkeypatch.setattr(stands, "CELLS", 100)  # both ways of counting, and batches that hold a part of the requests
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        made = stands.learnt(spark.createDataFrame(asks, "q string, s string").repartition(3))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert made.stands == whole.stands and "many" in made.stands
    assert made.hints == {w: x for w, x in whole.hints.items() if not w[-1].isdigit()}
    assert made.seen == {w for w in whole.seen if not w[-1].isdigit()} and made.common == {w for w in whole.common if " " not in w}
    assert stands.learnt(spark.createDataFrame([], "q string, s string")).stands == {}


def test_words_of_few_requests_among_many_are_learnt(spark):
    rows = [(i, [("user", f"total of locker item number {i % 90}")], (("SELECT SUM(x) AS value FROM t WHERE service = 'locker'",),)) for i in range(8_000)]
    rows += [(10_000 + i, [("user", f"total of drone item number {i}")], (("SELECT SUM(x) AS value FROM t WHERE service = 'drone'",),)) for i in range(5)]
    rec = spark.createDataFrame(rows, "record_id long, prompt array<struct<role string, content string>>, reward_model struct<ground_truth struct<verification_sql string>>")
    assert cross_split.learnt(rec).of("total of drone item number 3".split()) == {"service=": "'drone'"}


def test_crf_learns_a_sequence_rule():
    rng = random.Random(5)
    seqs, tags = [], []
    for _ in range(200):
        x = [rng.randrange(2) for _ in range(rng.randrange(1, 7))]
        seqs.append([hashed([f"x{v}"], 64) for v in x])
        tags.append([int(v and i > 0 and x[i - 1]) for i, v in enumerate(x)])  # needs the chain only in part
    crf = CRF(["a", "b"], 64).fit(seqs, tags, rounds=80)
    right = sum(p == t for ps, ts in zip(crf.decode(seqs), tags) for p, t in zip(ps, ts))
    assert right / sum(map(len, tags)) > 0.75


def _answers(n, seed=3):
    """(answer, question, defect) of n pairs in two languages, some of them refusals."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        code, figure = f"{rng.randrange(100, 999)}-{rng.randrange(100, 999)}-{rng.randrange(100, 999)}", rng.choice([str(rng.randrange(2, 9000)), f"{rng.uniform(1, 900):.2f}"])
        if i % 2:
            q = f"算出货重合计。口径：波次BC{code}，2024年6月，驿站达，已撤单，单票至少为18千克。"
            a = rng.choice([figure, f"经核对，结果为 {figure}。", f"**最终答案：{figure}**", f"抱歉刚才的语句有误，已重跑。结果：{figure}", f"| 类别 | 数值 |\n| --- | ---: |\n| 驿站达 | {figure} |\n| 大件达 | 3.5 |", '[{"category":"W1","value":%s},{"category":"W2","value":7}]' % figure, f"1. 驿站达：{figure}\n2. 大件达：88"]) + rng.choice(["", "", "\n查询只读，没有改动数据。", "\n边界月份按左闭右开处理。"])
            no = rng.choice(["抱歉", "对不起", "不好意思"]) + "，" + rng.choice(["我没有权限执行查询", "我不能回答这个问题", "这个请求我没法完成"]) + "，请联系管理员。"
        else:
            q = f"Please find the total weight. Scope: wave BC{code}, June 2024, locker, withdrawn, single weight at least 18 kg. The briefing still lacks one line."
            a = rng.choice([figure, f"The answer is {figure}.", f"After checking, the result is {figure}.", f"Unfortunately the first attempt timed out, here is the retry. Result: {figure}", f"| category | value |\n| --- | ---: |\n| locker | {figure} |\n| bulky | 3.5 |", f"locker {figure}, bulky 9.5."]) + rng.choice(["", "", "\nThe query was read only.", "\nLate rows count by their first load time."])
            no = rng.choice(["Sorry", "Unfortunately", "I regret"]) + ", " + rng.choice(["I cannot help with that request", "I am not able to open this database", "this is beyond what I can do"]) + "."
        out.append((no, "Workspace\nTask: " + q, "refusal") if i % 13 == 0 else (a, "Workspace\nTask: " + q, None))
    return out


def test_answer_defects(spark):
    q_en, q_zh = "Task: " + BASE, "算出货重合计。口径：波次BC004-182-928，2024年6月，驿站达，已撤单，单票至少为18千克。"
    cases = [
        ("The answer is 12.5. The query was read only.", q_en, None), ("12", q_en, None), ("", q_en, "empty"), ("> ", q_zh, "empty"), ("最终答案：", q_zh, "empty"), (None, q_zh, "empty"),
        ("Sorry, I cannot help with that request.", q_en, "refusal"), ("Sorry, this is beyond what I can do. Data on BC004-182-928 is internal.", q_en, "refusal"), ("抱歉刚才的语句有误，已重跑。结果：5", q_zh, None), ("Question: " + BASE, q_en, "copied"), (BASE.upper(), q_en, "copied"),
        ("Question: " + BASE + "\nAnswer: 5", q_en, None), ('[{"category":"W1","value":3},{"category":"W2","va', q_zh, "truncated"), ("| 类别 | 数值 |\n| --- | ---: |\n| 驿站达 | 8 |\n| 大件", q_zh, "truncated"), ("经核对，结果为 369。查询只读，没有", q_zh, "truncated"), ("After checking, the result is 22. Late rows count by their fi", q_en, "truncated"),
        ("Das Ergebnis lautet 17, berechnet für den genannten Zeitraum.", q_zh, "other_language"), ("The answer is 17. The query was read only.", q_zh + "请用英文作答。", None), ("The answer is 17. The query was read only.", q_zh, "other_language"), ("经核对，结果为 36。查询只读，没有改动数据。", q_en, "other_language"), ("The answer is 17. " * 4000, q_en, None),
    ]
    pool = cases + _answers(900)
    t = spark.createDataFrame([(i, i if i != 3 else None, a, "o</think>" + (a or "")) for i, (a, _, _) in enumerate(pool)], "trajectory_id long, record_id long, final_answer string, trajectory_output string")
    r = spark.createDataFrame([(i, [("user", q)], "clash") for i, (_, q, _) in enumerate(pool)], "record_id long, prompt array<struct<role string, content string>>, trajectory_output string")
    got = {x.trajectory_id: x.defect for x in answer_defects.judge(t, r).collect()}
    assert {i: got.get(i) for i in range(len(cases))} == {i: d for i, (_, _, d) in enumerate(cases)}
    wrong = [(a, got.get(i), d) for i, (a, _, d) in enumerate(pool) if got.get(i) != d]
    assert len(wrong) <= 9, wrong[:5]
    assert answer_defects.judge(t.limit(0), r).count() == 0


def test_the_field_tags_clauses_it_has_not_seen():
    pool = [(a, q) for a, q, _ in _answers(1200)]
    crf = answer_defects.fit(pd.DataFrame(pool[:700], columns=["a", "q"]))
    seqs, tags = answer_defects.made(pd.DataFrame(pool[700:], columns=["a", "q"]), seed=5)
    pairs = [(t, p) for ts, ps in zip(tags, crf.decode([[hashed(f, answer_defects.DIMS) for f in s] for s in seqs])) for t, p in zip(ts, ps)]
    assert sum(t == p for t, p in pairs) / len(pairs) > 0.97
    for tag in range(5):
        own = [p for t, p in pairs if t == tag]
        assert own and sum(p == tag for p in own) / len(own) > 0.85, answer_defects.TAGS[tag]


def test_cut_texts(spark):
    whole = [f"Run {i} took {i * 7} minutes, and the other side has been told. We will look at it again next week." for i in range(30)]
    text = [(w, "a") for w in whole] + [(whole[3][:-14], "a"), ('[{"category": "x", "va', "a"), ("CREATE TABLE t (id TEXT", "a"), ("| a | 1 |\n| b", "a"), ("4511", "a"), ("OK", "a"), ("OK", "a"), ("OK", "a"), (None, "a"), ("  ", None), ("Look at it again next week", "a")]
    long = [("y" * k + " and the other side has been told about it in good time so that nobody had to wait", "lim") for k in range(30, 60)]
    text += [(t[:90], s) for t, s in long]
    chat = spark.createDataFrame([(i, s, [(t,)]) for i, (t, s) in enumerate(text)], "chat_id long, source_label string, messages array<struct<content string>>")
    tra = spark.createDataFrame([(1, None), (2, [])], "trajectory_id long, pi_tool_events array<struct<source string, response_preview string>>")
    got = {r.row_id for r in cut_texts.judged(cut_texts.texts(chat, tra)).where(cut_texts.verdict()).collect()}
    assert got == {30, 31, 32, 33} | {i for i, (t, s) in enumerate(text) if s == "lim"}
    assert cut_texts.judged(cut_texts.texts(chat.limit(0), tra)).count() == 0


def _items():
    rng = random.Random(9)
    towns = [a + b for a in ("Wex", "Kel", "Ost", "Fal", "Bran", "Mor") for b in ("by", "ham", "ford", "wick", "ness")]
    return pd.DataFrame({"item_id": range(60), "text": [f"This exercise is sealed. At the depot of {rng.choice(towns)} a clerk booked {rng.randrange(100, 999)} crates on day {rng.randrange(100, 999)} and {rng.randrange(100, 999)} more once the crew of {rng.choice(towns)} arrived." for _ in range(60)]})


def test_leaks(spark):
    it = _items()
    t = it.text.tolist()
    words = t[7].split()
    docs = [
        (1, "Before. " + t[5] + " After."), (2, "x <b>" + t[5].upper().replace(" ", "\n> ") + "</b>"), (3, "This exercise is sealed."), (4, " ".join(words[8:13])), (5, t[7].replace("clerk", "clrek").replace("crates", "boxes")), (6, t[7].replace(words[12], "1" + words[12])[:0] + "At the depot of Zed a clerk booked 5 crates on day 6 and 7 more once the crew of Yam arrived."),
        (7, None), (8, ""), (9, "lorem ipsum " * 200_000 + t[9]), (5, t[7]), (10, t[11].replace("e", "е")),
    ]
    df = spark.createDataFrame([(i, x, 0) for i, x in docs], "doc_id long, text string, item_id int")
    got = {(r.doc_id, r.item_id) for r in leak.leaks(df, it).collect()}
    assert got == {(1, 5), (2, 5), (5, 7), (9, 9), (10, 11)}
    assert leak.leaks(df.limit(0), it).count() == 0
    assert leak.leaks(df, it.iloc[:0]).count() == 0


def test_plain_tokens():
    assert tokens("Caf\\u00e9 &amp; ＢＣ12​3<br>") == ["cafe", "bc", "1", "2", "3"]
    assert codes("ab").tolist() == [97, 98]


def test_mixture_keeps_quotas_and_caps(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, "big").when(F.col("id") < 1520, "small").when(F.col("id") < 1530, None).otherwise("other").alias("source"), (F.col("id") % 17).alias("tokens"))
    target = spark.createDataFrame([("m", "big", 0.5, 2, 0.5), ("m", "small", 0.4, 3, 0.5), ("m", "none", 0.1, 3, 0.5), ("m", "other", None, 3, 0.5), ("m", None, 0.1, 3, 0.5), ("z", "big", 0.0, 3, 0.5)], "mix_name string, source string, target_share double, max_repeats int, budget_factor double")
    chosen, placed, _ = (x.cache() for x in mixture.mixed(docs, target))
    corpus = docs.agg(F.sum("tokens")).first()[0]
    got = {r.source: (r.t, r.u) for r in chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("t"), F.max("uses").alias("u")).collect()}
    assert 0 <= 0.25 * corpus - got["big"][0] <= 17 and got["big"][1] == 1
    small = docs.where("source = 'small'").agg(F.sum("tokens")).first()[0]
    assert got["small"] == (3 * small, 3)  # asked for more than its cap
    assert placed.where("shard < 0 or shard >= 64").count() == 0
    per = [r["count"] for r in placed.groupBy("shard").count().collect()]
    assert len(per) == 64 and max(per) < 8 * min(per)  # equal units of some three documents
    assert placed.count() == chosen.agg(F.sum("uses")).first()[0] == placed.select("doc_id", "pass").distinct().count()


def test_empty_corpora(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string, tokens long")
    target = spark.createDataFrame([("m", "a", 1.0, 1, 1.0)], "mix_name string, source string, target_share double, max_repeats int, budget_factor double")
    assert [x.count() for x in mixture.mixed(docs, target)] == [0, 0, 0]
    assert mixture.token_counts(docs).count() == 0
    labels = spark.createDataFrame([(1, "a", 3)], "doc_id long, rater string, grade int")
    assert reading_level.graded(docs, labels).count() == 0
    assert layout_copies.copies(layout_copies.keyed(request_key(docs.select(F.col("doc_id").alias("id"), "text"), "text", "key"), "task")).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=5), st.integers(1, 9), st.integers(0, 5))
def test_splitting_tree_is_exact(quotas, shards, seed):
    s = mixture.split_quotas(np.array(quotas), shards, np.random.default_rng(seed))
    assert s.sum(0).tolist() == quotas and s.min() >= 0 and s.sum(1).max() - s.sum(1).min() <= 1


def test_reading_level(spark):
    rng = random.Random(2)
    vocab = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "bdgklmnrst"]
    rows, labels = [], []
    for i in range(200):
        hard = i % 10 + 1
        text = " ".join(" ".join(vocab[min(int(rng.expovariate(1 / (6 * hard))), len(vocab) - 1)] for _ in range(4 + 2 * hard)) + "." for _ in range(6))
        rows.append((i, text, "s", "en", 1))
        if i % 2:
            labels += [(i, "a", hard), (i, "b", hard + 1), (i, "b", None)]
    rows += [(500, None, None, None, 1), (501, "", "s", "zh", 1), (502, "。，", "s", "zh", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, grade int")
    g = {r.doc_id: r.grade for r in reading_level.graded(docs, spark.createDataFrame(labels, "doc_id long, rater string, grade int")).collect()}
    assert len(g) == 203 and g[500] is None and g[501] is None and g[502] is None
    error = np.mean([abs(g[i] - (i % 10 + 1.5)) for i in range(0, 200, 2)])
    assert error < 1.2  # documents without labels
    none = spark.createDataFrame([], "doc_id long, rater string, grade int")
    assert all(r.grade is None for r in reading_level.graded(docs, none).collect())


def test_coverage_rank_equals_brute_force(spark):
    texts = ["the cat and the dog", "the the the", "仓库里的仓", "a cat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocab = reading_level.vocabulary(docs)
    rank = {r.word: r["rank"] for r in vocab.collect()}
    by_hand = {}
    for i, t in enumerate(texts):
        r = sorted(rank[w] for w in reading_level.words(t))
        by_hand[i] = r[int(np.ceil(0.92 * len(r))) - 1]
    for most in (10**6, 6, 3, 1):
        assert {r.doc_id: r.coverage_rank for r in reading_level.features(docs, vocab, most).collect()} == by_hand


def _copies(spark, rows):
    """{id: middle} of (id, text, suspect) by near_copies."""
    d = spark.createDataFrame([(i, len(t), s, t) for i, t, s in rows], "id long, chars int, suspect boolean, text string")
    return {r.id: r.middle for r in cut_texts.near_copies(d).collect()}


def test_a_cut_text_meets_its_copy_behind_longer_texts(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(70)]
    text = " ".join(words)
    rows = [(1, text[:-3], True), (2, text + " and more", False)]
    for i in range(40):  # longer texts of the same buckets that end in another way
        rows.append((10 + i, " ".join([*words[:-1], *("".join(rng.choice("mnopqr") for _ in range(12)) for _ in range(3))]), False))
    assert _copies(spark, rows) == {1: True}


def test_the_end_of_a_cut_text_is_aligned_with_its_copy(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(160)]
    text, edited = " ".join(words), " ".join([*words[:40], "other", *words[41:]])
    dropped = " ".join(words[:40] + words[41:])
    copy = text + " and goes on for a while. Then it ends"
    cuts = {1: edited[:-3], 2: dropped[:-2], 3: text, 4: text.upper(), 5: edited, 6: text + " and goes on for a while.", 7: " ".join([*words[:-1], "elsewhere"])}
    got = _copies(spark, [(99, copy, False), *((i, t, True) for i, t in cuts.items())])
    assert {i for i, m in got.items() if m} == {1, 2, 3, 4, 5}


def test_a_cut_text_meets_a_copy_that_opens_otherwise(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(120)]
    opening = ["".join(rng.choice("mnopqrst") for _ in range(6)) for _ in range(16)]
    text = " ".join(words)
    copies = [(99, " ".join([*opening, text]) + " and goes on for a while", False), (98, " ".join([*opening[:9], *words[9:]]) + " and more", False)]
    assert _copies(spark, [(1, text[:-3], True), copies[0]]) == {1: True}
    assert _copies(spark, [(1, text[:-3], True), copies[1]]) == {1: True}


def test_a_text_that_its_limit_shows_cut_needs_no_copy(spark, monkeypatch):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(60)]
    cuts = [" ".join([*words[:i], "other", *words[i + 1 :]])[:300] for i in range(5)]
    rows = [("chat_log", i, 0, "a", t) for i, t in enumerate(cuts)] + [("chat_log", 9, 0, "b", cuts[0]), ("chat_log", 10, 0, "b", " ".join(words) + " and it ends.")]
    rows = spark.createDataFrame(rows, "table_name string, row_id long, pos long, source string, text string")
    seen, near_copies = [], cut_texts.near_copies
    monkeypatch.setattr(cut_texts, "near_copies", lambda d: seen.append({r.text for r in d.where("suspect").collect()}) or near_copies(d))
    some, every = (sorted((r.row_id, r.cut) for r in cut_texts.judged(rows, **how).withColumn("cut", cut_texts.verdict()).collect()) for how in ({}, {"all_copies": True}))
    assert some == every == [*((i, True) for i in range(5)), (9, True), (10, False)]
    assert seen == [{cuts[0]}, set(cuts)]  # the first stands in a source without a limit, too


def test_codes_of_a_batch_are_of_the_same_tokens(monkeypatch):
    rng = random.Random(13)
    parts = ["a", "b", "_", "Z", "1", "23", ".", "..", "１", "中", "é", "İ", "Σ", "ﬁ", "½", "²", "𝟙", "𐐀", " ", "\n", "\0"]
    texts = ["", ".5", "6.", *("".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)), "1.2.3.4.5"]
    words = [cut_texts._tokens(t) for t in texts]
    for chars in (1, 70, 10**6):
        monkeypatch.setattr(cut_texts, "CHUNK_CHARS", chars)
        found = [cut_texts._batch_codes(x) for x in cut_texts._chunks(pd.Series(texts))]
        assert [x for _, n in found for x in n] == [len(w) for w in words]
        both = set(zip((x for w in words for x in w), (int(x) for code, _ in found for x in code), strict=True))
        assert len(both) == len({w for w, _ in both}) == len({c for _, c in both})


def test_a_leak_without_numbers(spark):
    bare = "The harbour master of Quellmond sealed every lantern crate before the northern ferries came home that evening"
    shared = "A weaver from the hills bartered seven bolts of undyed linen for one barrel of salted plums at dusk"
    it = pd.concat([_items(), pd.DataFrame({"item_id": [70, 71, 72, 73], "text": [bare, shared, shared + " again", bare]})])
    docs = [(1, "We read: " + bare + ". So it was."), (2, "We read: " + shared + "."), (3, " ".join(bare.split()[:10])), (4, bare.replace("lantern", "lantren"))]
    got = {(r.doc_id, r.item_id) for r in leak.leaks(spark.createDataFrame(docs, "doc_id long, text string"), it).collect()}
    assert got == {(1, 70), (1, 73), (4, 70), (4, 73), (2, 71), (2, 72)}


def test_other_numbers_and_names_are_no_leak(spark):
    it = _items()
    other = it.text.tolist()[7].replace("This exercise is sealed. ", "")
    other = " ".join(w if not w.isdigit() else str(int(w) + 1) for w in other.split())
    assert leak.leaks(spark.createDataFrame([(1, other)], "doc_id long, text string"), it).count() == 0


def test_removal_spans_are_places_of_the_document(spark, monkeypatch):
    it = _items()
    q = it.text.tolist()[7].split(". ")[1]
    text = f"Caf\\u00e9 first. {q}. Then {'filler ' * 40}and again: <b>{q.replace(' ', '  ')}</b>"
    docs = spark.createDataFrame([(1, text), (1, text), (2, "x " * 3000 + q + " y" * 3000)], "doc_id long, text string")
    items = spark.createDataFrame(it)

    def spans():
        return sorted((r.doc_id, r.start, r.end) for r in leak.merged_spans(leak.found(docs, items)).where("item_id = 7").collect())

    whole = spans()
    texts = {1: text, 2: "x " * 3000 + q + " y" * 3000}
    assert [i for i, _, _ in whole] == [1, 1, 2]
    for i, a, z in whole:
        assert " ".join(texts[i][a:z].split()) == q[: len(" ".join(texts[i][a:z].split()))] and z - a > len(q) - 12
    monkeypatch.setattr(leak, "SHARD_CHARS", 4_000)  # in overlapping pieces
    assert spans() == whole


def test_items_in_parts_give_the_same(spark):
    it = _items()
    docs = spark.createDataFrame([(i, "Before. " + t + " After.") for i, t in enumerate(it.text)], "doc_id long, text string")
    items = spark.createDataFrame(it)
    whole = {(r.doc_id, r.item_id) for r in leak.found(docs, items, places=False).collect()}
    parts = {(r.doc_id, r.item_id) for r in leak.found(docs, items, places=False, most=3_000).collect()}
    assert {(i, i) for i in range(60)} == whole == parts


def test_features_of_repeated_rows_are_the_same_in_both_branches(spark):
    rows = [(1, "the cat and the dog"), (1, "the cat and the dog"), (2, "zebras run"), (2, "a cat and the dog sat"), (3, "仓库里的仓")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vocab = reading_level.vocabulary(docs)
    small, large = ({r.doc_id: (r.words, r.coverage_rank, r.x2, r.x3, r.x4) for r in reading_level.features(docs, vocab, most).collect()} for most in (10**6, 1))
    assert small == large and {i: x[0] for i, x in small.items()} == {1: 5, 2: 6, 3: 5}
