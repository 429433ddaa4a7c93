"""URL templates, decontamination, surrogates, backoff scores and the pipeline."""

import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from oracle import compare, connect

import corpus_pipeline
from groupaudit.llm import backoff_lm, decontaminate, language, queries, simhash, surrogates, url_templates

RULES = queries.RULES


# --- URLs ---------------------------------------------------------------------------------------


def split_url(url):
    m = re.match(r"(?s).*?://([^/?#]*)(/[^?#]*)?", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2] or "") if m else ("", "")


def brute_rule(host, path):
    fit = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda r: len(r[0])) if fit else (None, None)


def shape(s):
    name, ext = re.fullmatch(r"(?s)(.*?)(\.[A-Za-z]{1,5})?", s).groups()
    if re.fullmatch(r"[0-9]+", name):
        name = "{n}"
    elif re.fullmatch(r"[0-9a-fA-F-]{8,}", name):
        name = "{hex}"
    elif re.search(r"[0-9]", name) and re.search("[A-Za-z]", name):
        name = "{id}"
    return name + (ext or "")


def brute_templates(urls, fan_out=16, weight=2.0, threshold=0.5):
    """The tree built node by node in memory."""
    rows = []
    for u in urls:
        host, path = split_url(u)
        rule, verdict = brute_rule(host, path)
        rows.append((host, path, rule, verdict, [shape(s) for s in path.split("/") if s]))
    labelled = [r for r in rows if r[3]]
    base = sum(r[3] == "block" for r in labelled) / len(labelled) if labelled else 0.0
    rate = lambda rs, up: (sum(r[3] == "block" for r in rs) + weight * up) / (sum(r[3] is not None for r in rs) + weight)
    out = {}

    def grow(members, level, up):
        here = [r for r in members if len(r[4]) > level]
        for r in members:
            if len(r[4]) == level:
                out[id(r)] = up
        children = {}
        for r in here:
            children.setdefault(r[4][level], []).append(r)
        variable = len(children) >= fan_out and sum(len(c) == 1 for c in children.values()) >= 0.5 * len(children)
        merged = {}
        for seg, c in children.items():
            p, n = rate(c, up), sum(r[3] is not None for r in c)
            half = 1.96 * math.sqrt(p * (1 - p) / (n + weight))
            side = "+" if p - half >= threshold else "-" if p + half < threshold else "?"
            merged.setdefault(("*", side, max(len(r[4]) for r in c)) if variable else seg, []).extend(c)
        for c in merged.values():
            grow(c, level + 1, rate(c, up))

    for host in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == host]
        grow(own, 0, rate(own, base))
    return sorted((r[0], r[1], r[2] or "", r[3] or ("block" if out[id(r)] >= threshold else "allow")) for r in rows)


def test_url_query_matches_brute_force(spark, sf):
    got = queries.QUERIES["op5_url_templates"](spark, sf).collect()
    urls = [r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").select("url").collect()]
    assert sorted((r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in got) == brute_templates(urls)


def test_templates_merge_variable_branches(spark):
    urls = [f"http://a.com/en/{w}/x" for w in "alpha beta gamma delta".split()] + [f"http://a.com/t/{chr(97 + i)}word/p{i}" for i in range(20)]
    urls += [f"http://a.com/en/{chr(97 + i)}item" for i in range(24)] * 2 + [f"http://b.org/es/{chr(97 + i)}q" for i in range(24)]
    urls += ["http://b.org/es2/w", None, "x", "HTTP://A.Com?q", "http://net/de/x//y#z", "http://net/de/x//y#z", "://", "http://xcom/en/"]
    urls += ["http://deep.com/" + "/".join("abcdefghijklmn"), "http://long.com/" + "a" * 50_000]
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = url_templates.template_verdicts(df, RULES, levels=20).collect()
    assert sorted((r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in got) == brute_templates(urls)
    assert any("*" in r["template"] for r in got)
    by = {r["page_id"]: r for r in got}
    assert (by[urls.index(None)]["host"], by[urls.index("HTTP://A.Com?q")]["host"]) == ("", "a.com")
    assert url_templates.template_verdicts(df.where("false"), RULES).count() == 0


# --- decontamination ----------------------------------------------------------------------------


def brute_scores(items, passage):
    """Every item's BM25 score against a passage, over its score against itself."""
    ws = [decontaminate.words(t) for t in items]
    n, mean = len(ws), sum(map(len, ws)) / len(ws)
    df = Counter(t for w in ws for t in set(w))

    def weight(t, w):
        f = w.count(t)
        return math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean))

    there = set(decontaminate.words(passage))
    return [sum(weight(t, w) for t in set(w) & there) / sum(weight(t, w) for t in set(w)) for w in ws]


ITEMS = [f"{a} {b} the cat number{i} sat on mat{i}. The answer{i} is {b}{a}." for i, (a, b) in enumerate([("red", "fox"), ("blue", "dog"), ("old", "man")] * 20)]


def index_of(spark, items):
    import pandas as pd

    entries = spark.createDataFrame([(0, i, 0, decontaminate.words(t)) for i, t in enumerate(items)], "shard long, row long, seg int, ws array<string>")
    rows = [(i, i, *decontaminate.question_and_answer(t)) for i, t in enumerate(items)]
    return decontaminate.Index(decontaminate._postings(entries).toPandas(), pd.DataFrame(rows, columns=["row", "item_id", "question", "answer"]), 5)


@pytest.mark.parametrize("threshold", [0.2, 0.6, 0.9])
def test_block_max_retrieval_is_complete(spark, threshold):
    index = index_of(spark, ITEMS)
    for passage in (ITEMS[3], ITEMS[3] + " " + ITEMS[40], "the cat sat on mat7 blue", "nothing here"):
        import numpy as np

        terms = np.array(sorted(index.terms[w] for w in set(decontaminate.words(passage)) if w in index.terms), dtype=np.int64)
        got = {index.owner[e]: s for e, s in index.retrieve(terms, threshold).items()} if len(terms) else {}
        want = {i: s for i, s in enumerate(brute_scores(ITEMS, passage)) if s >= threshold}
        assert got == pytest.approx(want)


def test_contaminated_documents_of_all_lengths(spark):
    filler = " ".join(f"w{i % 977}" for i in range(40_000))
    long_item = " ".join(f"u{i}" for i in range(150)) + ". " + " ".join(f"v{i}" for i in range(9)) + "."
    items = spark.createDataFrame([(i, t, "z") for i, t in enumerate(ITEMS)] + [(900, long_item, "z"), (901, None, "z"), (902, "", "z"), (903, ITEMS[0], "z")], "item_id long, text string, doc_id string")
    docs = [
        (1, filler + " " + ITEMS[5].upper() + " " + filler), (2, "x " + long_item + " y"), (3, filler), (4, None), (5, ""),
        (6, ITEMS[5].split(". ")[0]), (7, ITEMS[0]), (7, ITEMS[0]), (None, ITEMS[1]), (8, " ".join(reversed(ITEMS[5].split()))),
    ]
    df = spark.createDataFrame([(i, t, "own") for i, t in docs], "doc_id long, text string, item_id string")
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in decontaminate.contaminated(df, items).collect())
    assert got == [(0, 1), (1, 5), (2, 900), (7, 0), (7, 0), (7, 903), (7, 903)]
    kept = decontaminate.decontaminate(df, items)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6, 8]
    assert decontaminate.contaminated(df, items.where("false")).count() == 0
    assert decontaminate.contaminated(df.where("false"), items).count() == 0


def test_contamination_query_finds_every_verbatim_item(spark, sf):
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op7_benchmark_decontamination"](spark, sf).collect()}
    flat = lambda name: [(r[0], f" {' '.join(decontaminate.words(r[1]))} ") for r in spark.read.parquet(f"{sf}/{name}.parquet").select("doc_id" if name == "documents" else "item_id", "text").collect()]
    assert got == {(d, i) for d, t in flat("documents") for i, w in flat("benchmark") if w in t}


def test_items_with_an_edited_word_or_without_last_sentence(spark):
    body = " ".join(f"p{i}" for i in range(30)) + ". "
    last = "q0 q1 q2 q3 q4 q5 q6 q7."
    long_last = " ".join(f"r{i}" for i in range(60)) + "."
    items = spark.createDataFrame([(1, body + last), (2, "s0 s1 s2 s3 s4 s5. " + long_last)], "item_id long, text string")
    docs = [
        (1, "x " + body + last.replace("q4", "edited") + " y"), (2, "x " + body), (3, body.replace("p9 ", "edited ") + last), (4, last),
        (5, "s0 s1 edited s3 s4 s5. " + long_last), (6, "s0 s1 s2 s3 s4 s5."), (7, " ".join(f"p{i}" for i in range(15)) + " " + last),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, items).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (5, 2)]
    parted = spark.createDataFrame([(1, body + last, body, last)], "item_id long, text string, q string, a string")
    got = decontaminate.contaminated(df, parted, question="q", answer="a").select("doc_id").collect()
    assert [r["doc_id"] for r in got] == [3]  # an answer that is given must be there


# --- surrogates ---------------------------------------------------------------------------------


def luhn(s):
    d = [int(c) for c in reversed(re.sub(r"\D", "", s))]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10


def test_surrogates_keep_kind_format_gender_and_identity(spark):
    text = (
        "Mrs. Anna Weber met Mr Weber and Dr Olga Weber; Госпожа Иванова wrote to anna.w99@mail5.example.com from 10.20.130.5 "
        'with token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", card 4111 1111 1111 1111 or 4785380592391139, +1 (743) 555-3824, '
        "123-45-6789 and DE89370400440532013000. Version 1.2.3.4.5 and 2024-01-02 stay. Again Mrs. Anna Weber, 10.20.130.5!"
    )
    rows = [(1, text, len(text), "own"), (1, text, 3, "own"), (2, None, None, "k"), (3, "", 0, "k"), (4, "nothing", 7, "k"), (None, "call 10.20.130.5", 16, "k"), (5, "pad " * 30_000 + "a@b.org", 120_007, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, value string")
    got = surrogates.pseudonymise(df, key="k").collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == set(df.columns)
    new, again = (r["text"] for r in got if r["doc_id"] == 1)
    assert new == again
    m = re.fullmatch(
        r"Mrs\. (\w+) (\w+) met Mr (\w+) and Dr (\w+) (\w+); Госпожа (\w+) wrote to ([a-z]+\.[a-z]\d\d@[a-z]{4}\d\.example\.com) from (\S+) "
        r'with token = "([0-9a-f]{40})", card (4\d{3} \d{4} \d{4} \d{4}) or (4\d{15}), (\+1 \(\d{3}\) \d{3}-\d{4}), '
        r"(\d{3}-\d{2}-\d{4}) and (DE\d{20})\. Version 1\.2\.3\.4\.5 and 2024-01-02 stay\. Again Mrs\. (\w+) (\w+), (\S+)!",
        new,
    )
    assert m, new
    anna, weber, mr, olga, dr, ivanova, *_ = g = m.groups()
    assert weber == mr == dr == g[15] and anna == g[14] != olga and anna.endswith("na")
    assert re.fullmatch("[А-Яа-я]+", ivanova) and g[7] == g[16] and all(int(o) < 256 for o in g[7].split("."))
    assert not any(x in new for x in ("Weber", "Anna", "Olga", "Иванова", "10.20.130.5", "24be64439e", "5555-3824", "123-45-6789"))
    assert luhn(g[9]) == luhn("4111111111111111") and luhn(g[10]) == luhn("4785380592391139")
    assert [r["text"] for r in got if r["doc_id"] is None] == [f"call {g[7]}"]
    assert {r["doc_id"]: r["text"] for r in got if r["doc_id"] in (2, 3, 4)} == {2: None, 3: "", 4: "nothing"}
    lengths = sorted((r["n_chars"], len(r["text"])) for r in got if r["doc_id"] == 1)
    assert lengths[0][0] == 3 and lengths[1][0] == lengths[1][1]
    assert surrogates.pseudonymise(df.where("false"), key="k").count() == 0
    other = [r["text"] for r in surrogates.pseudonymise(df, key="other").collect() if r["doc_id"] == 4 or r["doc_id"] is None]
    assert "nothing" in other and f"call {g[7]}" not in other


def test_names_without_their_title_are_the_same_person(spark):
    text = "Anna came. Mrs Anna Weber met Mr Παπάς; Weber said so to Anna, WEBER's wife, and Παπάς. Weberstadt, weber and Olga stay, Weber@b.org not."
    rows = [(1, text), (2, "Anna Weber is elsewhere"), (3, 'Mr Weber: token = "Weberweber"; Weberweber')]
    got = {r["doc_id"]: r["text"] for r in surrogates.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), key="k").collect()}
    m = re.fullmatch(r"(\w+) came\. Mrs (\w+) (\w+) met Mr (\w+); (\w+) said so to (\w+), (\w+)'s wife, and (\w+)\. Weberstadt, weber and Olga stay, (\w+)@b\.org not\.", got[1].replace(got[1].split("@")[1].split(" ")[0], "b.org"))
    assert m, got[1]
    first, anna, weber, greek, weber2, anna2, shouted, greek2, _ = m.groups()
    assert first == anna == anna2 != "Anna" and weber == weber2 != "Weber" and shouted == weber.upper() and greek == greek2 != "Παπάς"
    assert re.fullmatch("[Α-Ωα-ως]+", greek)
    assert got[2] == rows[1][1] and got[3].startswith(f"Mr {weber}: token") and got[3].endswith("; Weberweber")


def test_collisions_are_drawn_again(spark):
    values = [("ip", f"1.1.1.{i}") for i in range(1, 10)] + [("social", f"{i:03d}-00-0000") for i in range(300)] + [("name_f", f"N{i}") for i in range(400)]
    table = surrogates.surrogate_table(spark.createDataFrame(values, "kind string, value string"), key="k").collect()
    drawn = [r["surrogate"] for r in table]
    assert sorted((r["kind"], r["value"]) for r in table) == sorted(values)
    assert len(set(drawn)) == len(values) and not set(drawn) & {v for _, v in values}


def test_no_value_is_left_in_the_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r["text"] for r in queries.QUERIES["op10_pii_surrogates"](spark, sf).collect()}
    find = re.compile(r'[\w.+-]+@[\w.-]+\.\w+|\+1 \(\d+\) \d+-\d+|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])|(?<!\d)\d{16}(?!\d)|(?<=oken = ")\w+|(?<=OKEN = ")\w+')
    seen = {}
    for d, t in docs.items():
        old, new = find.findall(t or ""), find.findall(got[d] or "")
        assert find.sub("#", t or "") == find.sub("#", got[d] or "") and len(old) == len(new)
        for a, b in zip(old, new):
            assert a != b and seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen) > 5 and not set(seen) & set(seen.values())


def test_masks_signs_scripts_and_exhausted_formats(spark):
    """Nothing raises over data: masks stay, signs and any script are mapped, a full format grows."""
    secrets = ["********", "!@#$%^&*", "密码密码密码密码", "パスワードひみつです", "пароль-пароль", "סודסודסודסוד", "aaaaaaaaa", "x1!y2?z3"]
    rows = [(i, f'password = "{s}"') for i, s in enumerate(secrets)]
    mails = [f"{a}@{b}.org" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"] + [f"{a}{a}@x.org" for a in "abc"]
    rows.append((100, " ".join(mails)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in surrogates.pseudonymise(df, key="k").collect()}
    for i, s in enumerate(secrets):
        new = got[i][len('password = "') : -1]
        if len(set(s)) == 1:
            assert new == s
        else:
            assert new != s and len(new) == len(s), (s, new)
            assert all(a.isalpha() == b.isalpha() and a.isdigit() == b.isdigit() for a, b in zip(s, new))
    new = got[100].split()
    assert len(new) == len(set(new)) == len(mails) and not set(new) & set(mails)
    assert all(re.fullmatch(r"[a-z]+@[a-z]+\.org", m) for m in new)


# --- columns that are called like inner ones -------------------------------------------------------

INNER = ["_id", "_LABEL", "_contained_items", "_surrogate_list", "_text_digest", "_surrogate_names", "n", "row", "fingerprint", "group", "task", "p"]


def test_stages_keep_columns_of_any_name(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    extra = docs.selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in INNER], "'d' AS `a.b`")
    odd = extra.limit(2).withColumn("text", F.lit(None).cast("string")).union(extra.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    for table in (extra, extra.union(odd), extra.where("false")):
        kept = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, kept, sf)
            if name == "best_fit_packing":
                assert out.count() >= kept.count()
                break
            assert out.columns == table.columns, name
            rows = out.collect()
            assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in INNER if r["doc_id"] is not None), name
            kept = spark.createDataFrame(rows, table.schema)


# --- backoff scores -----------------------------------------------------------------------------


def test_scores_match_sql(spark, sf):
    got = queries.QUERIES["op6_backoff_scores"](spark, sf).toArrow()
    assert compare(got, connect(sf).sql(queries.SQL["op6_backoff_scores"]).to_arrow_table()) == []


def test_scores_of_odd_rows(spark):
    rows = [(1, "a b A\tb c", "x"), (1, "a b", "x"), (None, "a", "x"), (2, None, "x"), (3, " \n", "x"), (4, "b " * 20_000, "x"), (5, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, before string")
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    assert compare(backoff_lm.backoff_scores(df).toArrow(), con.sql(queries.SQL["op6_backoff_scores"]).to_arrow_table()) == []
    assert backoff_lm.backoff_scores(df.where("false")).count() == 0


def brute_backoff(texts, order, least, alpha=0.4):
    ws = [t.lower().split() for t in texts]
    count = Counter(tuple(w[i : i + k]) for w in ws for k in range(1, order + 1) for i in range(len(w) - k + 1))
    total, step, out = sum(map(len, ws)), round(math.log(alpha) * 1e6), []
    for w in ws:
        score = 0
        for i in range(len(w)):
            fit = [k for k in range(2, order + 1) if i >= k - 1 and count[tuple(w[i - k + 1 : i + 1])] >= least]
            k = max(fit, default=1)
            p = count[tuple(w[i - k + 1 : i + 1])] / (count[tuple(w[i - k + 1 : i])] if k > 1 else total)
            score += round(math.log(p) * 1e6) + (order - k) * step
        out.append((len(w), score))
    return out


@pytest.mark.parametrize("order, least", [(2, 1), (3, 2), (3, 1), (4, 2)])
def test_scores_of_higher_orders(spark, order, least):
    texts = ["a b c d a b c e", "a b c d", "x a b c", "b c d a", "e", "", "c c c c c c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["log_score"]) for r in backoff_lm.backoff_scores(df, order=order, least=least).collect()}
    assert [got[i] for i in range(len(texts))] == brute_backoff(texts, order, least)


def test_blocks_and_parts_add_up_without_a_row_per_word(spark):
    texts = [" ".join(f"w{(i * j) % (7 + i % 5)}" for j in range(i % 40)) for i in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert "Generate" not in backoff_lm.backoff_scores(df)._jdf.queryExecution().executedPlan().toString()
    for order, least in ((2, 2), (3, 2)):
        scored = backoff_lm.backoff_scores(df, order=order, least=least, block_words=100, part_words=50)
        got = {r["doc_id"]: (r["n_words"], r["log_score"]) for r in scored.collect()}
        assert [got[i] for i in range(len(texts))] == brute_backoff(texts, order, least)


# --- pipeline -----------------------------------------------------------------------------------


def test_every_stage_acts_on_what_the_last_one_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs
    states = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == columns, name
        kept = spark.createDataFrame(kept.toPandas(), docs.schema)
        states.append({r["doc_id"]: r["text"] for r in kept.collect()})
    told, alone, clean, private = states
    assert set(told) == {r["doc_id"] for r in language.language_id(docs).where("lang_pred <> 'und' AND score >= 0.2").collect()}
    first = {r["component_id"] for r in simhash.simhash_components(docs.where(docs.doc_id.isin(list(told)))).collect()}
    assert set(alone) == first
    items = [" ".join(decontaminate.words(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(clean) == {d for d, t in alone.items() if not any(w in " ".join(decontaminate.words(t)) for w in items)}
    assert set(private) == set(clean) and any(private[d] != t for d, t in clean.items())
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in packed} == set(private)
