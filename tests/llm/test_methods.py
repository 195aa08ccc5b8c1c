"""The dealt methods: each against a plain version, and that it is the method that decides."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.llm import common, cotrain, decontaminate, packing, passages, pii, quality_rules, shards, simhash, tokens, url_rules

from test_ops import TEXTS, all_rows, docs, prose, rows_of, words


def driver(spark, name, sf="sf0.01"):
    return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")


# --- URL filters ---------------------------------------------------------------------------------------


def url_tokens(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = m.groups() if m else ("", "")
    q = re.search(r"\?([^#]*)", url or "")
    out = {f"h:{w}" for cut in (r"[.]", r"[.:@-]") for w in re.split(cut, host)} | {f"p:{w}" for w in re.split(r"[/._-]", path)}
    out = {t for t in out if re.search("[^0-9]", t[2:])}
    return out | ({f"q:{w}" for w in re.sub("=[^&]*", "", q[1]).split("&") if w} if q else set())


def plain_rules(rows, min_pages, most):
    """{tokens: (confidence, pages)} by counting all combinations of the kept tokens of each url."""
    base, n = sum(b for _, b in rows) / len(rows), len(rows)
    sets = [(url_tokens(u), b) for u, b in rows]
    count, bad = Counter(t for s, _ in sets for t in s), Counter(t for s, b in sets if b for t in s)
    need = max(min_pages, int(np.ceil(url_rules.MIN_SUPPORT * n)))
    rank = {t: (-round(abs(bad[t] - c * base) / c**0.5, 9), t) for t, c in count.items() if c >= need}
    all_, hit = Counter(), Counter()
    for s, b in sets:
        kept = sorted((t for t in s if t in rank), key=rank.get)[:most]
        for k in range(1, len(kept) + 1):
            for some in itertools.combinations(sorted(kept), k):
                all_[some] += 1
                hit[some] += b
    least = min(url_rules.MIN_LIFT * base, (1 + base) / 2)
    good = {s: hit[s] / c for s, c in all_.items() if c >= need and hit[s] / c >= least - 1e-12 and hit[s] / c >= base + url_rules.MIN_DEVIATIONS * (base * (1 - base) / c) ** 0.5}
    return {s: (c, all_[s]) for s, c in good.items() if not any(good.get(x, -1) >= c for k in range(1, len(s)) for x in itertools.combinations(s, k))}


@pytest.mark.parametrize("most", [8, 3])
def test_url_rules_against_all_combinations(spark, most):
    r = random.Random(1)
    rows = [(f"https://{r.choice(['www', 'm', 'blog'])}.{r.choice(['ab', 'cd-ef', 'gh'])}.org/{r.choice(['en', 'fr', 'de'])}/{k}{r.choice(['', '.html', '?ref=1&utm=2'])}", 0) for k in range(300)]
    rows = [(u, int(r.random() < (0.8 if "cd-ef" in u and "/fr/" in u else 0.5 if "blog" in u else 0.15))) for u, _ in rows]
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(k, 1 - b, 0) for k, (_, b) in enumerate(rows)], "doc_id long, quality int, toxic int")
    got = {tuple(x.tokens): (x.confidence, round(x.support * len(rows) / x.confidence)) for x in url_rules.mine(pages, labels, min_pages=10, most=most).collect()}
    want = plain_rules(rows, 10, most)
    assert len(want) > 2 and got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)
    verdict = {x.page_id: x.verdict for x in url_rules.judge(pages, labels).collect()}
    rules = plain_rules(rows, url_rules.MIN_PAGES, url_rules.MAX_TOKENS)
    assert all(verdict[k] == ("block" if any(set(s) <= url_tokens(u) for s in rules) else "allow") for k, (u, _) in enumerate(rows))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_mined_rules_decide_urls(spark, sf):
    got = url_rules.judge(driver(spark, "pages", sf), driver(spark, "labels", sf)).where("rule is null").groupBy("verdict").count().collect()
    n = dict(map(tuple, got))
    assert 0 < n["block"] < n["allow"]


def test_url_with_many_tokens(spark):
    path = "/".join(f"w{chr(97 + k)}x" for k in range(26))
    pages = spark.createDataFrame([(k, f"http://site.org/{path}?a{k}=1") for k in range(60)] + [(100 + k, f"http://other{k}.org/x") for k in range(60)], "page_id long, url string")
    labels = spark.createDataFrame([(k, 0, 0) for k in range(60)] + [(100 + k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    got = {x.page_id: x.verdict for x in url_rules.judge(pages, labels).collect()}
    assert all(got[k] == "block" and got[100 + k] == "allow" for k in range(60))


def test_url_rule_of_weak_tokens(spark):
    # bad if both: each of the two tells nothing alone, and ten others of the same url tell more
    r = random.Random(4)
    rows = []
    for k in range(2000):
        one, two = r.random() < 0.5, r.random() < 0.5
        bad = one == two
        path = "/".join([*(["red"] if one else []), *(["blue"] if two else []), *(f"w{chr(97 + j)}x" for j in range(10) if r.random() < (0.96 if bad else 0.9))])
        rows.append((f"http://site.org/{path}", int(bad and (one or r.random() < 0.3))))
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(k, 1 - b, 0) for k, (_, b) in enumerate(rows)], "doc_id long, quality int, toxic int")
    got = {tuple(x.tokens): (x.confidence, round(x.support * len(rows) / x.confidence)) for x in url_rules.mine(pages, labels, min_pages=300).collect()}
    want = plain_rules(rows, 300, None)
    assert ("p:blue", "p:red") in want and got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


# --- personal data -------------------------------------------------------------------------------------


def plain_disclosing(texts):
    texts = set(texts)
    of_term, of_entity, both = Counter(), Counter(), Counter()
    for t in texts:
        of_term.update({pii.normal(w) for w in words(t)} - {""})
        spans = pii.protected(t)
        found = {(e, x) for es, near in pii.mentions_of(t, spans) for e in es for x in near}
        both.update(found)
        of_entity.update({e for es, _ in pii.mentions_of(t, spans) for e in es})
    n = len(texts)
    return {x for (e, x), k in both.items() if k >= pii.MIN_TEXTS and k >= pii.MIN_SHARE * of_term[x] and np.log2(n * k / (of_term[x] * of_entity[e])) >= pii.MIN_BITS}


@pytest.mark.parametrize("seed", [1, 2])
def test_disclosing_terms_against_plain_counts(spark, seed):
    r = random.Random(seed)
    values = ["ann@corp.example", "bob@corp.example", "10.1.2.3", "10.1.9.9", "4111111111111111", "+1 (555) 010-2030", "k9" * 8 + "Qx7Zp3Lm8R"]
    names = ["Zebulon", "Abimelech", "invoice", "hotline", "token"]
    texts = []
    for k in range(500):
        t = prose(r.randint(5, 60), f"{seed}-{k}").split()
        for _ in range(r.choice([0] * 9 + [1, 2])):
            x = r.randrange(5)
            t[r.randrange(len(t)) : 0] = [f"{names[x]},", values[r.choice([x, x, r.randrange(7)])]]
        if r.random() < 0.1:
            t.insert(r.randrange(len(t)), names[r.randrange(5)])
        texts += [" ".join(t)] * r.choice([1, 1, 1, 4])
    want = plain_disclosing(texts)
    assert want and {x.term for x in pii.disclosing(docs(spark, texts + [None, ""])).collect()} == want


def test_classes_of_entities_and_secrets(spark):
    texts = [f"{prose(9, k)} helpdesk user{k}@corp.example {prose(9, 100 + k)}" for k in range(6)]  # no address twice
    key = lambda k: f"{random.Random(k).getrandbits(160):040x}"
    texts += [f'{prose(9, 200 + k)} apikey = "{key(k)}" {prose(9, 300 + k)}' for k in range(6)]
    texts += [prose(40, 400 + k) for k in range(80)] + ["a" * 40, "1234567890" * 5, "under_score_" * 4, "Donaudampfschifffahrtsgesellschaft"]
    d = docs(spark, texts)
    assert {"helpdesk", "apikey"} <= {x.term for x in pii.disclosing(d).collect()}
    got = {x.doc_id: x for x in pii.find(d).collect()}
    assert all(got[k].n_spans == 2 and "term:" in got[k].spans for k in range(6))
    for k in range(6, 12):
        at = texts[k].index('"') + 1
        assert f"secret:{at}:{at + 40}" in got[k].spans and got[k].n_email == 0
    assert all(got[k].n_spans == 0 for k in range(12, len(texts)))
    clean = {x.doc_id: x.text for x in pii.sanitise(d).collect()}
    assert all('"[SECRET]"' in clean[k] and "apikey" not in clean[k] for k in range(6, 12)) and all(clean[k] == texts[k] for k in range(12, len(texts)))


def test_terms_in_chunks(spark, monkeypatch):
    d = docs(spark, [f"{prose(6, k)} {'alpha beta gamma'.split()[k % 3]} mail{k % 3}@x{k % 3}.example {prose(6, 50 + k)}" for k in range(15)] + [prose(30, 100 + k) for k in range(60)])
    want = rows_of(pii.find(d))
    monkeypatch.setattr(pii, "CHUNK_TERMS", 1)
    assert rows_of(pii.find(d)) == want and sum("term" in r[-2] for r in want) >= 15


# --- quality -------------------------------------------------------------------------------------------


def test_quality_ratio_against_plain_counts(spark):
    texts = [prose(70, 700 + k) + (" scum scum" if k % 5 == 0 else "") for k in range(120)]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(80)], "doc_id long, quality int, toxic int")
    ratios, cut = quality_rules.fit(d, labels)
    grams = lambda t: words(t) + list(zip(words(t), words(t)[1:]))
    bucket = {}
    for t in texts:
        h = common.hashes_of(t)
        bucket.update(zip(grams(t), quality_rules.ngram_buckets(h, quality_rules.BUCKETS).tolist()))
    raw = Counter(bucket[g] for t in texts for g in grams(t))
    good = [t for k, t in enumerate(texts[:80]) if k % 5]
    kept = {}
    for r in quality_rules.judge(d, ratios, cut).collect():
        t = texts[r.doc_id]
        target = Counter(bucket[g] for x in good if quality_rules.fold_of(x) != quality_rules.fold_of(t) for g in grams(x))
        share = sum(target.values()) / sum(raw.values())
        llr = 0.0
        for g in grams(t):
            want = raw[bucket[g]] * share
            if abs(target[bucket[g]] - want) >= quality_rules.EVIDENCE * (want + 1) ** 0.5:
                llr += np.log((target[bucket[g]] + quality_rules.PSEUDO) / (want + quality_rules.PSEUDO))
        llr /= len(grams(t))
        assert r.llr == pytest.approx(llr, abs=1e-5)
        kept[r.doc_id] = r.kept
        assert r.kept == (not r.base_failed and r.llr >= cut)
    # the cut-off gains most over labelled rows, of all steps
    llr = {r.doc_id: r.llr for r in quality_rules.judge(d, ratios, cut).collect()}
    gain = lambda c: np.mean([llr[k] >= c for k in range(80) if k % 5]) + np.mean([llr[k] < c for k in range(80) if k % 5 == 0])
    assert gain(cut) == pytest.approx(max(gain(np.floor(x / quality_rules.STEP) * quality_rules.STEP) for x in llr.values()))


# --- co-training ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_both_views_hand_over_new_rows_in_every_round(spark, sf):
    model, rows, handed = cotrain.train(driver(spark, "documents", sf), driver(spark, "labels", sf))
    assert [x[:2] for x in handed] == [(n, v) for n in range(cotrain.ROUNDS) for v in ("text", "meta")]
    assert all(n > 0 for _, _, n in handed)
    got = cotrain.scored(rows, model).join(driver(spark, "labels", sf), "doc_id").groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {(r.quality, r.toxic): r.kept for r in got}
    assert share[1, 0] > 0.95 and share[0, 0] < 0.1 and share[1, 1] < 0.25


def test_surest_against_a_sort(spark):
    r = random.Random(2)
    rows = [(k, round(r.gauss(0, 2), 1), 0.0) for k in range(200)]  # many ties
    d = spark.createDataFrame(rows, "fh long, text double, meta double").repartition(3)
    taken = {k for k, _, _ in r.sample(rows, 40)}
    left = [x for x in rows if x[0] not in taken]
    want = {x[0] for x in sorted(left, key=lambda x: (-x[1], x[0]))[:15]} | {x[0] for x in sorted(left, key=lambda x: (x[1], x[0]))[:15]}
    got = cotrain.surest(d, "text", 15, taken)
    assert got.keys() == want and all(got[k] == pytest.approx(1 / (1 + np.exp(-z))) for k, z, _ in rows if k in got)


def test_one_view_teaches_the_other(spark):
    # words of a class that no labelled text has: only documents whose metadata tell the class teach them
    r = random.Random(3)
    old = {0: ["bad", "worse"], 1: ["good", "fine"]}
    new = {0: ["grim", "vile"], 1: ["nice", "neat"]}
    text = lambda some, k: " ".join(r.choice(some) if r.random() < 0.3 else w for w in prose(60, k).split())
    rows = [(k, text((old if k < 200 else new)[k % 2], k), "en", f"src{k % 2}", 300) for k in range(600)]
    rows += [(1000 + k, text(new[k % 2], 2000 + k), "en", "other", 300) for k in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)], "doc_id long, quality int, toxic int")
    right = lambda: np.mean([(x.p_text >= 0.5) == (x.doc_id % 2) for x in cotrain.score(d, labels).where("doc_id >= 1000").collect()])
    with_rounds = right()
    rounds, cotrain.ROUNDS = cotrain.ROUNDS, 0
    try:
        without = right()
    finally:
        cotrain.ROUNDS = rounds
    assert with_rounds >= without  # the words themselves are chosen on labelled rows
    model, _, handed = cotrain.train(d, labels)
    assert all(n > 0 for _, _, n in handed)


# --- sharding ------------------------------------------------------------------------------------------


def failing_once(store, when):
    """Let one commit fail: before it is made, or as that of a writer that died."""
    commit, state = store.commit, {"left": 1}

    def first(*a):
        if state["left"]:
            state["left"] = 0
            raise when
        return commit(*a)

    store.commit = first


def test_lost_commits_change_nothing(spark, tmp_path):
    d = docs(spark, [prose(60, k) for k in range(400)])
    store = shards.ShardStore(spark, f"file://{tmp_path}/s", fanout=4, base=4096, target=1 << 20)
    failing_once(store, RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        store.append(d, rows=20)
    store.append(d, rows=20)
    assert rows_of(store.read(d.schema)) == rows_of(d)
    failing_once(store, RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        store.compact()
    store.compact(keep=1)
    assert rows_of(store.read(d.schema)) == rows_of(d)


def test_two_writers(spark, tmp_path):
    d = docs(spark, [prose(60, k) for k in range(400)])
    one, two = (shards.ShardStore(spark, f"file://{tmp_path}/s", fanout=4, base=4096, target=1 << 20) for _ in range(2))
    one.append(d.where("doc_id < 200"), rows=20)
    commit = one.commit

    def late(*a):  # the other writer is quicker
        one.commit = commit
        two.append(d.where("doc_id >= 200"), rows=20)
        return commit(*a)

    one.commit = late
    assert one.compact_once()  # in vain
    assert rows_of(one.read(d.schema)) == rows_of(d)
    one.commit = lambda *a: (setattr(one, "commit", commit), two.compact_once(), commit(*a))[-1]
    one.compact(keep=1)
    assert rows_of(two.read(d.schema)) == rows_of(d)
    one.commit = lambda *a: (setattr(one, "commit", commit), two.append(d.limit(3)), commit(*a))[-1]
    one.append(d.limit(2))
    assert two.read(d.schema).count() == 405


def test_any_columns(spark):
    d = docs(spark, [prose(9, k) for k in range(30)] + [None, ""]).withColumns({"_metadata": F.lit("x"), "path": F.lit(1), "rows": F.array(F.lit(2)), "input_file_name": F.lit(None).cast("string")})
    assert shards.shard(d).count() == 32


def test_word_hashes(monkeypatch):
    r = random.Random(6)
    texts = ["", " \t", "a", "  a b\x0bc\rd\ne  ", "é日本 x\xa0y", *("".join(r.choice("abcdé \n") for _ in range(r.randint(0, 200))) for _ in range(60))]
    for segment in (common.SEGMENT, 7):
        monkeypatch.setattr(common, "SEGMENT", segment)
        of = {}
        for t in texts:
            h = common.hashes_of(t).tolist()
            assert len(h) == len(words(t))
            for w, x in zip(words(t), h):
                assert of.setdefault(w, x) == x  # the same wherever it stands
        assert len(set(of.values())) == len(of)  # and different words differ
        last = of if segment != 7 else last == of or pytest.fail("segments change hashes")


# --- substring dedup -----------------------------------------------------------------------------------


def test_automata_decide(spark):
    shared = prose(150, "automata")
    texts = [f"{prose(20, k)} {shared} {prose(20, 50 + k)}" for k in range(4)] + [prose(90, 100 + k) for k in range(4)]
    texts[0] += f" {shared} {prose(7, 60)}"
    d = docs(spark, texts)
    want = {r.doc_id: r.n_removed for r in passages.digest(d).collect()}
    assert [want[k] for k in range(8)] == [300] + [150] * 3 + [0] * 4
    # equal runs are named where a text has them first; the other places are found by the automaton
    runs = passages.repeated_runs(d).collect()
    first = {}
    for r in runs:
        first.setdefault(r.th, set()).update(i for x, y in passages.stretches(r.start, r.end, r["at"]) for i in range(x, y))
    assert sorted(map(len, first.values()))[:3] == [150] * 3 and 150 <= max(map(len, first.values())) < 300
    # and passages confirmed by equal hashes of other words would remove nothing: the automaton compares words
    other = passages.locate([(0, words(texts[4]), [" ".join(words(texts[1])[r.start : r.end]) for r in runs if r.end <= len(words(texts[1]))])])
    assert [g.sum() for _, _, g in other] == [0]


def test_locate_against_search():
    r = random.Random(4)
    texts = [[r.choice("ab") for _ in range(r.randint(0, 30))] for _ in range(60)]
    given = [(k, t, [" ".join(r.choices("abc", k=r.randint(1, 4))) for _ in range(r.randint(0, 3))]) for k, t in enumerate(texts)]
    for shard in passages._shards(given):
        every = {tuple(p.split(" ")) for _, _, ps in shard for p in ps}
        for k, t, gone in passages.locate(shard):
            want = [any(tuple(t[s : s + len(p)]) == p and s <= i < s + len(p) for p in every for s in range(len(t))) for i in range(len(t))]
            assert gone.tolist() == want


def test_copies_of_a_row_cost_one_gathering(spark):
    d = docs(spark, [prose(200, 1)]).unionByName(docs(spark, [prose(200, 1)])).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(200))))
    runs = passages.repeated_runs(d)
    assert runs.count() == runs.select("h", "v").distinct().count() < 40  # not for each row
    assert {(r.n_words, r.n_removed) for r in passages.digest(d).collect()} == {(200, 200)} and passages.digest(d).count() == 400


# --- packing -------------------------------------------------------------------------------------------


def test_packing_against_one_stream(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.tokenizer_path(tokens.BYTE_BPE))
    tok.encode_special_tokens = True
    d = docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    got = packing.pack(d, size=64).toPandas()
    ids = {i: tok.encode(t, add_special_tokens=False).ids + [1] for i, t in all_rows(d)}
    order = got[got.start == 0].sort_values(["sequence_id", "offset"]).doc_id.tolist()
    assert sorted(order) == sorted(ids)
    want, at = [], 0
    for i in order:
        k = 0
        while k < len(ids[i]):
            n = min(64 - at % 64, len(ids[i]) - k)
            want.append((i, k, n, packing.zlib.crc32(np.array(ids[i][k : k + n], "<u4").tobytes()), len(ids[i]), at // 64, at % 64))
            k, at = k + n, at + n
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(want)


# --- decontamination -----------------------------------------------------------------------------------


def scan(items, text):
    """{item: similarity of the best window} by comparing every window of every item's length."""
    out, w = {}, words(text)
    grams = lambda x: Counter(tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4)))
    for i, t in items:
        x = words(t or "")
        if not x or not w:
            continue
        n = min(len(x), len(w))
        best = 0
        for s in range(len(w) - n + 1):
            a, b = grams(x), grams(w[s : s + n])
            both = sum((a & b).values())
            best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
        if best >= 0.8:
            out[i] = best
    return out


def near_copies(seed, n=100):
    r = random.Random(seed)
    items = [(k, prose(r.randint(12, 70), f"i{seed}{k}")) for k in range(25)] + [(90, "tiny item"), (91, None), (92, "  ")]
    texts = []
    for k in range(n):
        x = words(r.choice(items[:25])[1])
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            x[r.randrange(len(x))] = "changed"
        texts.append(prose(r.randint(1, 20), f"a{seed}{k}") + " " + " ".join(x[: r.choice([len(x), len(x) - 2])]) + " " + prose(r.randint(1, 20), f"b{seed}{k}"))
    return items, [*texts, "so tiny item", "", "tiny", *(prose(60, f"c{seed}{k}") for k in range(10))]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_leaks_against_a_scan_of_all_windows(seed):
    items, texts = near_copies(seed)
    index = decontaminate.Index(items)
    found = wanted = 0
    for t in texts:
        want, got = scan(items, t), {x[0]: x[5] for x in index.leaks(t)}
        assert got.items() <= want.items() or all(got[k] == pytest.approx(want[k]) for k in got)
        found, wanted = found + len(got), wanted + len(want)
    assert wanted > 30 and found >= 0.99 * wanted


def test_blocks_make_the_candidates(monkeypatch):
    items, texts = near_copies(4)
    index = decontaminate.Index(items)
    before = sum(len(index.leaks(t)) for t in texts)
    r = np.random.default_rng(1)
    prints = index.prints[r.integers(0, len(index.ids), 200)].copy()
    flips = r.integers(0, 60, 200)
    for p, n in zip(prints, flips):
        for b in r.choice(128, n, replace=False):
            p[b // 8] ^= 1 << (b % 8)
    w, k = index.candidates(prints)
    pairs = set(zip(w.tolist(), k.tolist()))
    assert len(pairs) == len(w) < len(prints) * len(index.ids)
    distance = np.bitwise_count(prints[:, None] ^ index.prints[None]).sum(axis=2)
    assert {(int(a), int(b)) for a, b in zip(*np.nonzero(distance <= decontaminate.RADIUS))} <= pairs  # none within the radius is missed
    index.filed = [x[:0] for x in index.filed]
    index.first = [x * 0 for x in index.first]
    assert before > 0 and sum(len(index.leaks(t)) for t in texts) == 0  # without tables there are no leaks


def test_benchmark_in_chunks(spark, monkeypatch):
    items, texts = near_copies(5, 20)
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, texts)
    want = rows_of(decontaminate.leaks(d, bench))
    left = rows_of(decontaminate.drop_leaks(d, bench))
    monkeypatch.setattr(decontaminate.chunks, "__defaults__", (4000,))
    assert len(list(decontaminate.chunks(bench))) > 3
    assert rows_of(decontaminate.leaks(d, bench)) == want and rows_of(decontaminate.drop_leaks(d, bench)) == left


# --- SimHash -------------------------------------------------------------------------------------------


def test_dense_bucket_of_near_copies():
    base = np.uint64(0x0123456789ABCDEF)
    v = np.unique(np.concatenate(([base], base ^ (np.uint64(1) << np.arange(16, dtype=np.uint64)), [base ^ np.uint64((1 << a) | (1 << b)) for a in range(16) for b in range(a)])))
    links = simhash.bit_sliced_links(v)
    assert len(links) == len(v) - 1  # a spanning tree, not all pairs
    far = np.array([0, 0xFFFF], np.uint64)
    assert simhash.bit_sliced_links(far) == []


def test_keep_one_of_repeated_rows(spark):
    d = docs(spark, TEXTS)
    many = d.unionByName(d).unionByName(d.where("doc_id is null"))
    assert rows_of(simhash.keep_one(many)) == rows_of(simhash.keep_one(d))
