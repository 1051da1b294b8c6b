"""Operators of the llm subpackage against brute force, round trips and edge cases."""

import os
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("tidewright.llm")
from tidewright.llm import bpe, crf, decontaminate, htmltext, jpeg, language, media, ngramjoin, pitmanyor, sharding, tokenfiles, toxicity  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, repeated and tied rows, a long text, and extra columns with clashing names."""
    long = " ".join(f"word{i % 700} don't x{i}" for i in range(9000))
    texts = [None, "", " \n\t ", "one two", "one two", "ONE two", "a b c d e f g", "a b c d e f g", "Ünï çø漢字 😀's 12,5  km\n\n", "'s 's ''", "a" * 3000, " " * 2000, long, long + " tail"]
    rows = [(i if i != 4 else 3, t, "en" if i % 2 else None, None, None, 0.5, 7) for i, t in enumerate(texts)] + [(None, "lone row", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(df):
    return df.where("1 = 0")


def test_bpe_equals_the_library(odd):
    want = sorted((str(r.doc_id), *bpe.reference_digest(r.text, RANKS)) for r in odd.collect())
    for chunk, overlap, far in ((1_024, 128, 1 << 20), (200, 16, 10_000), (50, 2, 100)):
        got = bpe.digests(bpe.decode(bpe.encode(odd, RANKS, chunk, overlap, far, chunk, overlap), RANKS)).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe.encode(empty(odd), RANKS).count() == 0


def test_token_files_equal_the_library(odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    special = odd.selectExpr("doc_id + 900 as doc_id", "concat('hello <|endoftext|> world', text) as text").where("doc_id is not null and text is not null")
    docs = odd.where("doc_id is not null").select("doc_id", "text").unionByName(special)
    got = {}
    for r in tokenfiles.token_table(docs, JSON).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    start = 0
    for doc, text in rows:
        ids = t.encode(text, add_special_tokens=False).ids + [0]
        assert (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) in got[doc]
        start += len(ids)
    assert tokenfiles.token_table(empty(odd), JSON).count() == 0


def test_sharding_moves_rows_only_into_the_new_shard(odd):
    got = sharding.shard_documents(odd, [1.0] * 7).collect()
    assert all(r.grown_shard in (r["shard"], 7) for r in got)
    more = {(r.doc_id, r.text_crc32): r["shard"] for r in sharding.shard_documents(odd, [1.0] * 8).collect()}
    assert all(more[r.doc_id, r.text_crc32] == r.grown_shard for r in got)
    for s in {r["shard"] for r in got}:
        slots = sorted(r.slot for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    texts = {r.doc_id: (r.text or "").encode() for r in odd.collect() if r.doc_id not in (3, None)}
    assert all(r["size"] == len(texts[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in got if r.doc_id in texts)
    assert sharding.shard_documents(empty(odd), [1.0]).count() == 0


def test_sharding_follows_weights(spark):
    got = dict(map(tuple, sharding.assign_shards(spark.range(20000), "id", [1.0, 3.0]).groupBy("shard").count().collect()))
    assert 0.23 < got[0] / 20000 < 0.27


def brute_components(rows):
    sets = []
    for doc, text in rows:
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((doc, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                top[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((doc, len(s), least[find(i)]) for i, (doc, s) in enumerate(sets))


def test_near_duplicates_equal_brute_force(spark, odd):
    rng = np.random.default_rng(4)
    rows = []
    for base in range(6):
        text = [f"w{rng.integers(0, 400)}" for _ in range(60)]
        for copy in range(8):
            t = list(text)
            for k in rng.integers(0, 60, copy // 2):
                t[k] = f"edit{rng.integers(0, 10**6)}"
            rows.append((base * 8 + copy + 100, " ".join(t)))
    rows += [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.near_duplicates(docs).collect())
    assert got == brute_components(rows)
    assert ngramjoin.near_duplicates(empty(docs)).count() == 0


def test_decontamination_slots(spark):
    item = "If a train runs 120 km in 3 hours then how many km does it run in 5 hours on average per day"
    docs = [(1, "noise here " + item + " more"), (2, item.replace("120", "75").replace("3", "4").replace("5", "9")), (3, item.replace("5 hours", "5 hours")), (4, "nothing like it at all"), (5, None), (6, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(10, item), (11, None), (12, "x"), (13, "tiny item here")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(d, b).collect()}
    assert set(got) == {1, 2, 3} and got[2].changed_slots and not got[1].changed_slots
    twisted = item.replace("120 km in 3 hours then how many km", "120 km in 3 hours then how many km")
    assert twisted == item
    assert decontaminate.contamination(empty(d), b).count() == 0 and decontaminate.contamination(d, empty(b)).count() == 0


def test_inconsistent_slots_are_no_hit(spark):
    item = "take 7 and add 7 then take 7 and add 7 again"
    d = spark.createDataFrame([(1, "take 1 and add 2 then take 3 and add 4 again"), (2, "take 5 and add 5 then take 5 and add 5 again")], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.contamination(d, b).collect()] == [2]


def test_one_other_value_leaves_the_exact_windows(spark):
    item = "we saw Anna walk down to the old mill and then we heard Anna sing by the river while her brother asked whether Anna would come home before the long night fell on the village"
    apples = "she buys 2 apples at the market of the old town and then walks home for 2 hours along the quiet river"
    docs = [(1, item.replace("whether Anna", "whether Eva")), (2, apples.replace("2 apples", "5 apples").replace("2 hours", "7 hours"))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (2, apples)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contamination(d, b).collect()}
    assert set(got) == {(1, 1), (2, 2)} and got[1, 1].coverage > 0.9 and got[2, 2].changed_slots


def test_exact_copies_of_short_items(spark):
    items = [(1, "What is the capital city of old France?"), (2, "Min and max of a list are what?"), (3, "Quo vadis?"), (4, "Xyzzy")]
    docs = [(1, "Quiz\nWhat is the capital city of old France?"), (2, "he said (no). What is the capital city of old France?"), (3, "Example 3, What is the capital city of old France?"), (4, "of 12 Min and max of a list are what?"), (5, "he asked Quo vadis and left"), (6, "quo et vadis, xyzzy"), (7, "say Xyzzy."), (8, "what was the capital city of old France?")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(d, b).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 1), (3, 1), (4, 2), (5, 3), (7, 4)]
    assert all(r.coverage == 1 and not r.changed_slots for r in got)


def test_forward_backward_equals_the_plain_recursion():
    rng = np.random.default_rng(0)
    e, t, init = rng.normal(size=(300, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    first = np.array([0, 0, 130, 131, 300])
    got = crf.forward_backward(e, first, t, init)[0]
    for a, b in zip(first[:-1], first[1:], strict=True):
        if a == b:
            continue
        x, n = e[a:b], b - a
        fa, fb = np.zeros((n, 3)), np.zeros((n, 3))
        fa[0] = x[0] + init
        for i in range(1, n):
            fa[i] = x[i] + np.logaddexp.reduce(fa[i - 1][:, None] + t, 0)
        for i in range(n - 2, -1, -1):
            fb[i] = np.logaddexp.reduce(t + x[i + 1] + fb[i + 1], 1)
        p = fa + fb
        assert np.allclose(np.exp(p - np.logaddexp.reduce(p, 1)[:, None]), got[a:b])


def test_language_and_toxicity_edge_cases(spark, odd):
    rows = [("en", "the cat and the dog of the house"), ("de", "der hund und die katze im haus nicht")] * 20
    model = language.fit(rows)
    langs, scores, _ = language.predict([None or "", "123 !!", "the dog and the cat", "der hund und die katze"], model)
    assert langs == ["und", "und", "en", "de"] and scores[0] == 0.0
    assert {r.lang_pred for r in language.identify(odd, None).collect()} == {"und"}
    assert language.identify(empty(odd), model).count() == 0
    toxic = [(1, f"you idiot number w{i} fool") for i in range(40)] + [(0, f"a nice day number w{i} here") for i in range(60)]
    m = toxicity.fit(toxic)
    s, spans = toxicity.score(["", "what an idiot he is", "a nice walk"], m)
    assert s[1] > 0.5 > max(s[0], s[2]) and [("what an idiot he is"[x["start"] : x["end"]]) for x in spans[1]] == ["idiot"]
    assert toxicity.score(["x"], toxicity.fit([]))[0][0] < 0.5
    assert toxicity.tag(odd, m).count() == odd.count()


def test_every_language_is_learned(spark):
    langs = [f"l{i:02d}" for i in range(70)]
    rows = [(i * 4 + k, f"wort{chr(97 + i % 26)}{chr(97 + i // 26)} qu{chr(97 + i // 26)}{chr(97 + i % 26)}x " * 6, x) for i, x in enumerate(langs) for k in range(4 if i else 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.sample(docs, "doc_id", "lang", 3)
    assert {x for x, _ in found} == set(langs) and len(found) == 3 * len(langs)
    assert language.fit(found[:60] + [x for x in found if x[0] == "l69"]).labels[-1] == "l69"
    repeated = docs.unionByName(docs)
    assert len(language.sample(repeated, "doc_id", "lang", 3)) == 3 * len(langs)


def test_pitman_yor_base_and_sum(spark, odd):
    import math

    docs = odd.where("doc_id is not null").select("doc_id", "text")
    got = pitmanyor.score_documents(docs).collect()
    rows = [(r.doc_id, re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) + [None]) for r in docs.collect()]
    counts = {}
    for doc, w in rows:
        if zlib.crc32(str(doc).encode()) % 5 != 1:
            for x in w:
                counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((doc, len(w), sum(x in counts for x in w), round(sum(math.log10((counts.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for doc, w in rows)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and r.train_tokens == n for r in got)
    assert pitmanyor.score_documents(empty(docs)).count() == 0


def test_reseating_samples_the_conditional():
    """Mean tables against generalised Stirling numbers, for few and many customers and all kinds of weights."""
    for c, a, d in ((2, 0.3, 0.5), (10, 1.0, 0.5), (40, 1.0, 0.5), (40, 0.01, 0.8), (60, 30.0, 0.3), (25, 5.0, 0.9)):
        ways = np.zeros(c + 1)  # of seating so many customers at t tables, scaled
        ways[1] = 1
        for n in range(1, c):
            ways = np.append(0, ways[:-1]) + ways * np.maximum(n - d * np.arange(c + 1), 0)
            ways /= ways.max()
        p = ways * a ** np.arange(c + 1)
        want = (p * np.arange(c + 1)).sum() / p.sum()
        many = 4000
        one = np.ones(many)
        got = pitmanyor.reseat(one * c, one, one * 1e9, one * a / 1e9, d, pitmanyor.Draws(np.arange(many), 5), 12)[0].mean()
        assert got == pytest.approx(want, rel=0.05), (c, a, d)


def test_waiting_times_follow_the_same_process(monkeypatch):
    """Tables by single customers and by waiting times have the mean that the process has."""
    c, s, d = np.full(3000, 60.0), np.full(3000, 2.0), 0.4
    want = float(pitmanyor.expected_tables(c, s, d)[0])
    for lone in (1 << 20, 0):
        monkeypatch.setattr(pitmanyor, "LONE_CUSTOMERS", lone)
        assert pitmanyor.seat(c, s, d, pitmanyor.Draws(np.arange(3000), 9)).mean() == pytest.approx(want, rel=0.03)


def test_pitman_yor_learns_contexts(spark):
    """Words that are equally frequent are told apart by the word before, and the tables of contexts feed the corpus."""
    from collections import Counter

    texts = ["a b a b c d c d"] * 30 + ["b x c y"] * 5
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    model, table = pitmanyor.fit(train)
    pairs = Counter()
    for t in texts:
        w = t.split()
        pairs.update(zip([None, *w], [*w, "</s>"], strict=True))
    assert table.count() == len(pairs) and model.total == sum(pairs.values())
    state = {r.key: r for r in model.state.collect()}
    assert len(pairs) <= model.customers < model.total  # tables, not tokens
    assert abs(sum(r.ut for r in state.values()) - model.customers) < 1e-6
    assert all(r.tables <= r.customers + 1e-9 and r.customers <= r.c + 1e-9 for r in state.values())
    docs = spark.createDataFrame([(1, "a b"), (2, "a d"), (3, "zz b"), (4, "zz d")], "doc_id long, text string")
    got = {r.doc_id: r for r in pitmanyor.score(docs, model, table).collect()}
    assert got[1].base_score == pytest.approx(got[2].base_score, abs=0.2) and got[1].score > got[2].score + 0.5
    # after a seen and after an unseen word, the chances of all known words, the end and the unknown word sum to one
    known = sorted({x for t in texts for x in t.split()})
    for before in ("a", "zz"):
        rows = [(i, f"{before} {x}") for i, x in enumerate([*known, "qq"])] + [(99, before), (98, f"{before} {before}")]
        s = {r.doc_id: r.score for r in pitmanyor.score(spark.createDataFrame(rows, "doc_id long, text string"), model, table).collect()}
        # score(before x) = log p(before) + log p(x | before) + log p(end | x)
        ends = {r.doc_id: r.score for r in pitmanyor.score(spark.createDataFrame([(i, x) for i, x in enumerate([*known, "qq"])], "doc_id long, text string"), model, table).collect()}
        first = {r.doc_id: r for r in pitmanyor.score(spark.createDataFrame([(0, before)], "doc_id long, text string"), model, table).collect()}[0].score
        unit = pitmanyor.score(spark.createDataFrame([(0, "")], "doc_id long, text string"), model, table).first().score
        assert all(np.isfinite(v) for v in [*s.values(), *ends.values(), first, unit])
    total = _step_total(model, table, known)
    assert total == pytest.approx(1, abs=1e-9)


def _step_total(model, table, known):
    """Sum of the probabilities after the word a, from the model's tables."""
    keys = pitmanyor.hashed_events(known)[0]
    codes = pitmanyor.coded(np.unique(keys), model.hot)
    a = int(pitmanyor.coded(pitmanyor.hashed_events(["a"])[0], model.hot)[0])
    q = {(r.u, r.w): r.q for r in table.collect()}
    back = (pitmanyor.STRENGTH + model.context_discount * model.arrays["ut"][a]) / (pitmanyor.STRENGTH + model.arrays["uc"][a])
    return back * model.unknown + sum(q.get((a, int(w)), back * model.arrays["p"][w]) for w in codes)


def test_pitman_yor_scores_do_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 60) % 300)) for i in range(120)] + [(500, None), (501, ""), (None, "w1 w2"), (0, "again w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted((str(r.doc_id), r.n_tokens, round(r.score, 9)) for r in pitmanyor.score_documents(d).collect()) for d in (docs.coalesce(1), docs.repartition(5))]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    assert all(r.perplexity > 1 for r in pitmanyor.score_documents(docs).collect())


def test_payload_files_round_trip(odd):
    for p in (b"\0" * 64, os.urandom(64 * 301), bytes(range(256)) * 3):
        frame = jpeg.read_coefficients(media.pack(p))
        assert media.unpack(frame) == p and jpeg.to_rgb(frame).dtype == np.uint8
    got = media.read_back(media.store_payload(odd)).collect()
    assert len(got) == odd.count() and all(r.payload_bytes % 64 == 0 and r.payload_bytes > 0 for r in got)
    bad = media.decode_media(odd.selectExpr("doc_id", "cast('nonsense' as binary) as media"), ["doc_id"]).collect()
    assert all(r.rgb is None and r.error for r in bad)


def test_main_text():
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=/>home</a></li></ul></nav><div class=ad>buy it now</div><article><h1>Head &amp; line</h1><p>First long paragraph, with <b>bold</b>\n text and more of it.<br>x<p>Second &eacute; paragraph of the text, which goes on.</p><script>var a='<p>no</p>'</script></article><footer>&copy; 2020 someone</footer></body></html>"
    got = htmltext.extract_texts([page, None, "", "<p", "</div></p>"], htmltext.model())
    assert got[0] == "Head & line\n\nFirst long paragraph, with bold text and more of it. x\n\nSecond é paragraph of the text, which goes on."
    assert got[1:3] == ["", ""]


def test_boosting_learns_made_pages():
    right = leaves = 0
    for seed in range(50_000, 50_060):
        dom, y = htmltext.labelled_page(seed)
        keep = np.array(htmltext.decode(dom, htmltext.model().log_probabilities(htmltext.features(dom))))
        leaf = np.array([bool(t) for t in dom.text])
        right += ((y == htmltext.ARTICLE) == keep)[leaf].sum()
        leaves += leaf.sum()
    assert right / leaves > 0.98


def test_pitman_yor_steps_are_dense(spark):
    model, table = pitmanyor.fit(spark.createDataFrame([(f"a b c{i} d",) for i in range(9)], "text string"))
    assert all(x.endswith(".zstd.parquet") for df in (table, model.state) for x in df.inputFiles())


def test_pitman_yor_parts_equal_one_array(spark, monkeypatch):
    """Many parts with few hot words (so that most pairs and links are cold) give what one array of all pairs gives."""
    from collections import Counter

    py = pitmanyor
    for name, value in (("HOT_WORDS", 12), ("HOT_PAIRS", 5), ("PART_EVENTS", 300)):
        monkeypatch.setattr(py, name, value)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in (rng.integers(0, 40, 25) * rng.random(25)).astype(int)) for _ in range(110)]
    model, table = py.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert model.number > 5 and len(model.hot) <= 12

    def pairs(text):
        w, first = py.hashed_events([text])
        w = py.coded(w, model.hot)
        return list(zip(py.contexts(w, first).tolist(), w.tolist(), strict=True))

    counts = Counter(x for t in texts for x in pairs(t))
    u, w = np.array(list(counts)).T.copy()
    c = np.array(list(counts.values()))
    assert ((u < 0) & (w < 0) & (c > 1)).sum() > 20
    us, iu = np.unique(u, return_inverse=True)
    ws, iw = np.unique(w, return_inverse=True)
    t, m, tables, uc, wc = np.ones(len(c)), c > 1, np.ones(len(ws)), np.bincount(iu, c), np.bincount(iw, c)
    customers, ut = np.bincount(iw, t), np.bincount(iu, t)
    r = py.Rates(py._discount((customers == 1).sum(), (customers == 2).sum()), py._discount((c == 1).sum(), (c == 2).sum()), customers.sum(), len(ws), len(ws))
    for sweep in range(1, py.BURN_IN + 2):
        turns = py.SAMPLES if sweep > py.BURN_IN else py.TURNS
        t[m] = py.context_tables(u[m], w[m], c[m], t[m], ut[iu][m], r.word_probability(customers, tables)[iw][m], r, sweep, turns) / turns
        customers, ut = np.bincount(iw, t), np.bincount(iu, t)
        tables = py.corpus_tables(ws, customers, tables, r, sweep)
        r.customers, r.tables = customers.sum(), tables.sum()
    back, p = dict(zip(us.tolist(), r.backoff(uc, ut), strict=True)), dict(zip(ws.tolist(), r.word_probability(customers, tables), strict=True))
    q = dict(zip(zip(u.tolist(), w.tolist(), strict=True), np.maximum(c - r.context_discount * t, 0) / (1 + uc[iu]) + r.backoff(uc, ut)[iu] * r.word_probability(customers, tables)[iw], strict=True))
    got = {(x.u, x.w): x for x in table.collect()}
    assert got.keys() == q.keys() and all(got[k].q == pytest.approx(q[k], rel=1e-9) and got[k].c == counts[k] for k in q)
    assert {x.key: round(x.customers, 9) for x in model.state.collect() if x.c} == dict(zip(ws.tolist(), customers.round(9).tolist(), strict=True))
    docs = [*texts[:20], *(" ".join(f"w{int(x)}" for x in rng.integers(0, 60, 25)) for _ in range(20)), "zz w30 w31 zz w82 zz", ""]
    known = dict(zip(ws.tolist(), wc.tolist(), strict=True))
    scored = {x.doc_id: x for x in py.score(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), model, table, waves=2).collect()}
    for i, text in enumerate(docs):
        own = pairs(text)
        assert scored[i].score == pytest.approx(sum(np.log10(q.get(x, back.get(x[0], 1.0) * p.get(x[1], r.unknown))) for x in own), rel=1e-9)
        assert (scored[i].n_tokens, scored[i].n_known) == (len(own), sum(x[1] in known for x in own))
        assert scored[i].base_score == pytest.approx(sum(np.log10((known.get(x[1], 0) + 0.5) / (model.total + 0.5 * (model.distinct + 1))) for x in own))


def test_pitman_yor_steps_have_no_row_a_pair(spark, monkeypatch):
    rows, plain = {}, pitmanyor.materialise

    def counted(df, name):
        out = plain(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(pitmanyor, "materialise", counted)
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(x)}" for x in rng.integers(0, 300, 200))) for i in range(20)], "doc_id long, text string")
    assert pitmanyor.score_documents(docs.coalesce(1)).count() == 20
    assert max(n for name, n in rows.items() if name != "words") < 60


def test_pitman_yor_draws_do_not_depend_on_other_dishes():
    c, one = np.array([2.0, 3.0, 5.0, 40.0]), np.ones(4)
    for base in (0.3, 0.05):
        both = pitmanyor.reseat(np.repeat(c, 200), np.ones(800), np.full(800, 3.0), np.full(800, base), 0.6, pitmanyor.Draws(np.arange(800), 3), 4)
        for i in range(4):
            own = np.arange(200) + 200 * i
            assert (pitmanyor.reseat(np.repeat(c[i], 200), np.ones(200), np.full(200, 3.0), np.full(200, base), 0.6, pitmanyor.Draws(own, 3), 4) == both[:, own]).all()


def test_pitman_yor_seats_many_customers_in_few_steps(monkeypatch):
    """A dish draws some numbers for each table, not one for each customer, alone and beside others, with the same result."""
    drawn, plain = [], pitmanyor.mix

    def counted(x):
        drawn.append(len(x))
        return plain(x)

    c, s, d = np.full(30, 500_000.0), np.full(30, -0.3), 0.4
    monkeypatch.setattr(pitmanyor, "mix", counted)
    got = pitmanyor.seat(c, s, d, pitmanyor.Draws(np.arange(30), 9))
    assert sum(drawn) < 1_000_000
    alone = [pitmanyor.seat(c[:1], s[:1], d, pitmanyor.Draws(np.arange(i, i + 1), 9))[0] for i in range(30)]
    assert got.tolist() == alone
    monkeypatch.undo()
    want = float(pitmanyor.expected_tables(c[:1], s[:1], d)[0])
    assert pitmanyor.seat(np.full(4000, c[0]), np.full(4000, s[0]), d, pitmanyor.Draws(np.arange(4000), 2)).mean() == pytest.approx(want, rel=0.05)


def test_pitman_yor_draws_few_customers_from_the_conditional():
    """One turn is enough, whatever the tables before: 1 to 3 tables of three customers by their weights."""
    d, a, many = 0.3, 4.0, 40_000
    weight = np.cumprod([(1 - d) * (2 - d), 3 * (a + d) / (2 - d), (a + 2 * d) / (3 * (1 - d))])
    one = np.ones(many)
    for before in (1, 3):
        got = pitmanyor.reseat(3 * one, before * one, a * one, one, d, pitmanyor.Draws(np.arange(many), 5), 1)[0]
        assert np.bincount(got.astype(int), minlength=4)[1:] / many == pytest.approx(weight / weight.sum(), abs=0.01)


def test_pitman_yor_packs_by_the_bytes_in_use():
    rng = np.random.default_rng(6)
    small, hashes = rng.integers(0, 200, 4001), rng.integers(-(1 << 63), 1 << 63, 4001)
    for a, kind, most in ((small, "i8", 1), (small * 1.0, "f8", 1), (small / 3, "f8", 2), (rng.random(4001), "f8", 8), (hashes, "i8", 8.2), (np.where(small < 20, hashes, small), "i8", 2), (np.zeros(0), "f8", 0), (np.zeros(9), "f8", 1), (np.array([1 << 31, -1, 5]), "i8", 8), (np.array([np.nan, np.inf, -0.5]), "f8", 8)):
        b = pitmanyor.packed(a, kind)
        assert pitmanyor.unpacked(b, kind).dtype == kind and np.array_equal(pitmanyor.unpacked(b, kind), a, equal_nan=kind == "f8")
        assert len(b) <= most * len(a) + 8


def test_pitman_yor_slots_take_keys_in_any_order():
    keys = np.random.default_rng(7).integers(-(1 << 63), 1 << 63, 5000)
    keys[:50] = keys[50] + np.arange(1, 51)  # these share their first bits
    at, there = pitmanyor.Slots(keys)(np.append(keys, keys + (1 << 40)))
    assert there[:5000].all() and (keys[at[:5000]] == keys).all() and not there[5000:].any()
