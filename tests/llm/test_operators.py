"""Operators against brute force, and the defined results of odd inputs: nulls, blanks, long texts, repeats, empty tables, clashing names."""

import base64
import collections
import math
import random
import time
import zlib

import numpy as np
import pytest

from flowlake.llm import chat_format, common, curriculum_mix, decontaminate, html_extract, language_id, lm_score, near_dup, quality_classifier, quality_rules, secret_scan

from ..conftest import SF

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (4, "one", "b"), (5, LONG, "b"), (None, "null id here", "c"), (7, "Zed \x85 \xa0 über", "c")]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def tokens(text):
    return [w.decode() for w in (text or "").encode().split()]


def rules(text, width=5):
    w = tokens(text)
    spots = collections.defaultdict(list)
    for i in range(len(w) - width + 1):
        spots[tuple(w[i : i + width])].append(i)
    covered = {i + k for s in spots.values() if len(s) > 1 for i in s for k in range(width)}
    lines = [x for x in (text or "").split("\n") if tokens(x)]
    n = len(w)
    return n, sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_rules(spark, docs, odd, none):
    for df in (docs, odd.withColumnRenamed("source", "kept")):
        for r in quality_rules.clean_lines(df).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == rules(r.text), r.doc_id
            assert not (r.kept and r.base_failed)
    assert quality_rules.clean_lines(none).count() == 0
    words = spark.createDataFrame([(1, "The catalog in the hall is old.\nThey design in pairs every day of the week.\nLog in\nImpressum | Anmelden", "")], SCHEMA)
    assert quality_rules.clean_lines(words).first().clean_text == "The catalog in the hall is old.\nThey design in pairs every day of the week."
    clean = "A plain line of words, and more of them follow here.\nAnother plain line of words ends so."
    nav = "Home | News | Sport | Shop | Help | Login\n" * 3
    got = {r.doc_id: r for r in quality_rules.clean_lines(spark.createDataFrame([(1, clean + "\n" + nav, ""), (2, nav, ""), (3, "WOW!! BUY!! NOW!! " * 9 + "a b c d e f g h", ""), (4, clean, "")], SCHEMA)).collect()}
    assert not got[2].kept and not got[3].kept and got[4].kept and got[4].clean_text == clean and "|" not in got[1].clean_text


def test_secret_scan(spark, docs, odd, none):
    a = secret_scan._automaton()
    body = "0123456789abcdefghijABCDEFGHIJ"
    good, bad = f"ghp_{body}{secret_scan.crc_base62(body)}", f"ghp_{body}zzzzzz"
    texts = [r.text for r in docs.select("text").collect()] + [t for _, t, _ in ODD] + ['é PassWord"\' : "abc123 token=ab secret=tokentoken=abcdef', "AKIA" + "A" * 16 + " AKIAAKIA", "f" * 24 + "g" + "0" * 23, f"x {good} {bad}", "apikey=apikey=secretvalue", "ſecret=abcdef123"]
    for t in texts:
        spans = secret_scan.spans_of(t, a)
        base = [s for s in spans if s[2] in ("assign", "access", "hex")]
        assert [sum(s[2] == k for s in base) for k in ("assign", "access", "hex")] == list(secret_scan.brute_force(t)[:3]), t
    assert [s[2] for s in secret_scan.spans_of(f"x {good} {bad}", a)] == ["github"]
    head = base64.urlsafe_b64encode(b'{"alg":"HS256"}').rstrip(b"=").decode()
    jwt = f"{head}.eyJzdWIiOiIxMjM0NTY3ODkwIn0.abcdefghijklmnop"
    assert [s[2] for s in secret_scan.spans_of(f"eyJeyJ {jwt} eyJ", a)] == ["jwt"]
    t = time.process_time()
    assert secret_scan.spans_of("eyJ" * 300_000, a) == [] and secret_scan.spans_of(("eyJ" * 20 + ".") * 20_000, a) == [] and time.process_time() - t < 5
    assert secret_scan.redact("a token=abcdef b", secret_scan.spans_of("a token=abcdef b", a)) == "a [assign] b"
    out = secret_scan.scan_secrets(odd.withColumnRenamed("source", "secret_spans"), replace=True).collect()
    assert len(out) == len(ODD) and out[0].text is None and out[0].secret_spans == []
    assert secret_scan.scan_secrets(none).count() == 0
    got = secret_scan.op10_secret_scan(spark, SF).collect()
    want = {r.doc_id: secret_scan.brute_force(r.text) for r in docs.collect()}
    assert all((r.n_assign, r.n_access, r.n_hex, r.base_sha256) == want[r.doc_id] for r in got)


def test_curriculum_mix(spark, odd, none):
    rows = {(r.doc_id, r.size): r for r in curriculum_mix.mix_sources(odd).collect()}
    assert rows[(1, 0)].taken == 0 and rows[(1, 0)].position is None and len(curriculum_mix.mix_sources(odd).collect()) == len(ODD)
    assert curriculum_mix.mix_sources(none).count() == 0
    rnd = random.Random(1)
    many = spark.createDataFrame([(i, "x " * rnd.randint(1, 60), f"s{min(i % 9, 4)}") for i in range(3000)], SCHEMA)
    out = curriculum_mix.mix_sources(many).collect()
    total, by = sum(r.size for r in out), collections.defaultdict(list)
    for r in out:
        by[r.source].append(r)
        assert r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0 and (r.copies == 0) == (r.position is None)
        assert r.position is None or 0 <= r.position <= 1
    assert math.isclose(sum(v[0].target for v in by.values()), total, rel_tol=1e-9)
    for v in by.values():
        assert v[0].target <= 3 * v[0].source_size + 1e-6 and abs(sum(r.taken for r in v) - v[0].target) <= 60 * 3
    again = {r.doc_id: r.position for r in curriculum_mix.mix_sources(many.repartition(3)).collect()}
    assert again == {r.doc_id: r.position for r in out}


def test_chat_format(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", "twice"), (2, 0, "system", "alone"), (None, None, None, "x"), (3, 600, "ann", "late"), (3, 0, "bob", "early")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {(r.conv_id, r.participant, r.part): r for r in chat_format.rotate(df).collect()}
    ann = out[(1, "ann", 0)]
    assert ann.text == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n<|user name=bob|>\ntwice<|end|>\n"
    assert [ann.text[m.start : m.end] for m in ann.masks] == ["hi"]
    assert [out[(1, "bob", 0)].text[m.start : m.end] for m in out[(1, "bob", 0)].masks] == ["", "twice"]
    assert (2, "system", 0) not in out and (None, "unknown", 0) in out and {k for k in out if k[0] == 3} == {(3, p, n) for p in ("ann", "bob") for n in (0, 1)}
    assert chat_format.rotate(df.limit(0)).count() == 0


def test_chat_parts_make_one_dialogue(spark):
    rnd = random.Random(5)
    rows = [(1, k, rnd.choice(("ann", "bob", "c|>d", "system")), f"turn {k} <|end|> é" * rnd.randint(0, 3)) for k in range(40)] + [(None, None, "ann", "x"), (None, 9, "bob", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {(r.conv_id, r.participant): r for r in chat_format.rotate(df).collect()}
    parts = collections.defaultdict(list)
    for r in chat_format.rotate(df, part_turns=7).orderBy("part").collect():
        parts[r.conv_id, r.participant].append(r)
    assert parts.keys() == whole.keys() and (1, "c|>d") in whole
    for k, own in parts.items():
        text = whole[k].text
        assert "".join(r.text for r in own) == text and {r.n_parts for r in own} == {len(own)}
        assert [(r.offset + m.start, r.offset + m.end) for r in own for m in r.masks] == [(m.start, m.end) for m in whole[k].masks]
        assert text.count("<|") == text.count("|>") == 2 * sum(r.n_turns for r in own)


def edits(words, n, rnd):
    w = list(words)
    for i in rnd.sample(range(len(w)), n):
        w[i] = f"edit{i}"
    return w


def test_decontaminate(spark, docs, odd, none):
    rnd = random.Random(4)
    item = [f"b{i}" for i in range(57)]
    noise = lambda n: [f"n{rnd.randint(0, 9999)}" for _ in range(n)]
    rows = [(10, " ".join(noise(30) + item + noise(30))), (11, " ".join(noise(30) + edits(item[2:-2], 0, rnd) + noise(30))), (12, " ".join(noise(5) + item[:20] + noise(60))), (13, " ".join(item).upper()), (14, " ".join(noise(90))), (15, "tiny one")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "tiny one")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(frame, bench).collect()}
    assert got.keys() == {(10, 1), (11, 1), (13, 1), (15, 4)} and got[(10, 1)] == got[(13, 1)] == 1.0 and got[(11, 1)] >= 0.8
    assert {r.doc_id for r in decontaminate.decontaminate(frame, bench).collect()} == {12, 14}
    assert decontaminate.find_leaks(odd, bench).count() == 0 and decontaminate.find_leaks(none, bench).count() == 0 and decontaminate.find_leaks(frame, bench.limit(0)).count() == 0
    # Brute force over every window of an item's size.
    real = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = set()
    sh = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    texts = {r.doc_id: r.text.lower().split() for r in docs.collect()}
    items = {r.item_id: r.text.lower().split() for r in real.collect()}
    for k, w in items.items():
        a = sh(w)
        for d, t in texts.items():
            if a.keys() & sh(t).keys() and any(sum((a & b).values()) >= 0.8 * sum((a | b).values()) for i in range(max(1, len(t) - len(w) + 1)) for b in [sh(t[i : i + len(w)])]):
                want.add((d, k))
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, real).collect()} == want and want


def components(texts, num, den):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both) and find(a) != find(b):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("crowd,block", [(64, 256), (1, 4)])
def test_near_dup(spark, crowd, block):
    rnd = random.Random(9)
    base = [f"v{i}" for i in range(150)]
    texts = [(i, " ".join(edits(base, rnd.randint(0, 9), rnd))) for i in range(60)] + [(100 + i, " ".join(f"z{rnd.randint(0, 10**6)}" for _ in range(30))) for i in range(40)]
    texts += [(200, "short TEXT"), (201, "Short text"), (202, None), (203, ""), (204, "a b c d e f"), (205, "a b c d e f g")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, num=85, crowd=crowd, block=block).collect()}
    assert got == components(texts, 85, 100)


def test_near_dup_odd(odd, none):
    out = near_dup.near_duplicates(odd).collect()
    assert len(out) == len(ODD) and [r.component_id for r in out if r.doc_id is None] == [None]
    assert {r.component_id for r in out if r.doc_id == 4} == {4} and near_dup.near_duplicates(none).count() == 0


def test_bayes_bound():
    assert near_dup.fewest_matches(125, 0.85, 1e-6) < 125 * 0.85 and near_dup.fewest_matches(125, 0.85, 1e-6) > 125 * 0.6
    sets = [set(range(k, k + 100)) for k in (0, 10)]
    flat = np.concatenate([common.mix(np.array(sorted(s), np.uint64)) for s in sets])
    sig = near_dup.signatures(flat, np.array([0, 100, 200]), 2000)
    assert abs((sig[0] == sig[1]).mean() - 90 / 110) < 0.04


def test_lm_score(spark, docs, odd, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + k, t) for k, (_, t, _) in enumerate(ODD) if k != 5]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tok = {i: (t or "").encode().lower().split() + [None] for i, t in rows}
    train = {i for i in tok if zlib.crc32(str(i).encode()) % 7 != 2}
    count = collections.Counter(w for i in train for w in tok[i])
    n, v = sum(count.values()), len(count)
    for r in lm_score.score_corpus(df, bits=3).collect():
        t = tok[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(count[w] > 0 for w in t), n, r.doc_id not in train)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9) and r.score < 0
    out = lm_score.score_corpus(odd).collect()
    assert len(out) == len(ODD) and lm_score.score_corpus(none).count() == 0
    held = [(r.score, r.base_score) for r in lm_score.score_corpus(docs).collect() if r.held_out]
    assert sum(a for a, _ in held) > sum(b for _, b in held)


def test_em_weights():
    w = lm_score.learn_weights([(0, 0.0, 0.0, 0.01, 50), (3, 1.0, 1.0, 1e-5, 90), (3, 0.0, 0.0, 1e-5, 10)], 1e-6)
    assert np.allclose(w.sum(1), 1) and w[0, 2] > 0.9 and w[3, :2].sum() > 0.7 and np.allclose(w[63], w[3])


def lm_brute(tok, fold):
    """Scores by a trigram model counted in plain dictionaries, with EM on exact estimates."""

    def steps(i):
        u, v = "S0", "S"
        for w in tok[i]:
            yield u, v, w
            u, v = v, w

    def count(ids):
        c = [collections.Counter() for _ in range(5)]
        for i in ids:
            for u, v, w in steps(i):
                for k, key in enumerate((w, (v, w), (u, v, w), v, (u, v))):
                    c[k][key] += 1
        return c, sum(c[0].values())

    train = [i for i in tok if fold(i) != 2]
    main, full = count([i for i in train if fold(i) != 3]), count(train)
    uniform = 1 / (len(full[0][0]) + 1)

    def at(model, u, v, w):
        (one, two, three, ctx, ctx2), n = model
        level = ctx2[u, v].bit_length() if ctx2[u, v] else 64 + ctx[v].bit_length()
        return level, three[u, v, w] / max(ctx2[u, v], 1), two[v, w] / max(ctx[v], 1), one[w] / n

    cells = collections.Counter(at(main, *s) for i in train if fold(i) == 3 for s in steps(i))
    weights = lm_score.learn_weights([(*k, n) for k, n in cells.items()], uniform)
    score = lambda level, *p: math.log10(weights[level] @ np.array([*p, uniform]))
    return {i: sum(score(*at(full, *s)) for s in steps(i)) for i in tok}


def test_lm_score_against_brute_force_under_other_splits(spark):
    tok = {r.doc_id: (r.text or "").encode().lower().split() + [b""] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = lm_brute(tok, lambda i: zlib.crc32(str(i).encode()) % 7)
    lazy = lm_score.op3_lm_score(spark, SF)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:  # the last read is split otherwise than the first
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        got = {r.doc_id: r.score for r in lazy.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # The grid's cells stand for their means, which moves the learned weights a little.
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) <= 2e-3 * abs(want[i]) for i in want)


def test_lm_score_detects_other_texts():
    import pandas as pd

    answers = pd.DataFrame({"kind": [0], "bucket": [0], "total": [b"\x01\x01"], "devs": [b"\x01\x00"], "proof": [1]})
    with pytest.raises(RuntimeError):
        lm_score._lookup([b"a b"], answers, "total", 0, 64)


def test_quality_classifier(spark, docs, odd, none):
    labelled = docs.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    w = quality_classifier.fit_quality(labelled)
    assert all(0 <= r.score <= 1 for r in quality_classifier.score_quality(odd.withColumnRenamed("source", "score"), w).collect())
    assert quality_classifier.score_quality(none, w).count() == 0 and (quality_classifier.fit_quality(labelled.limit(0)) == 0).all()
    assert (quality_classifier.fit_quality(labelled.repartition(7)) == w).all() and len(quality_classifier.fit_quality(labelled.unionByName(labelled), max_features=50)) == len(w)


def test_ftrl_against_brute_force():
    """Features by regular expressions, updates and scores coordinate by coordinate."""
    import re

    texts = ["Good words, good words here.", "spam!!! $$$ buy buy buy now", "über größe x9", "", "words here again and again, fine", "$$$ !!! win"]
    y, bits = [1, 0, 1, 1, 1, 0], 12

    def naive(t):
        toks = re.findall(rb"[a-z0-9\x80-\xff]+|([!-/:-@\[-`{-~])\1*", t.lower().encode()) and [m[0] for m in re.finditer(rb"[a-z0-9\x80-\xff]+|([!-/:-@\[-`{-~])\1*", t.lower().encode())]
        ids, last = [], None
        for tok in toks or []:
            data = np.frombuffer(tok, np.uint8)
            h = common.hash_runs(data, np.array([0]), np.array([len(data)]))[0]
            ids.append(np.uint64(12345) if last is not None and h == last else h)
            last = h
        with np.errstate(over="ignore"):
            grams = ids + [common.mix(np.array([b * np.uint64(3) + a]))[0] for a, b in zip(ids, ids[1:])]
        count = collections.Counter(int(g >> np.uint64(64 - bits)) for g in grams)
        norm = math.sqrt(sum(count.values())) or 1.0
        return {**{k: math.sqrt(n) / norm for k, n in count.items()}, 1 << bits: 1.0}

    rows = [naive(t) for t in texts]
    for got, want in zip(quality_classifier.examples_of([t.encode() for t in texts], bits), rows, strict=True):
        assert np.allclose([want[c] for c in got[0].tolist()], got[1], rtol=1e-6) and len(want) == len(got[0])
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    alpha, beta, l1, l2 = 2.0, 1.0, 1e-4, 1e-3
    weight = lambda c: 0.0 if abs(z[c]) <= l1 else -(z[c] - math.copysign(l1, z[c])) / ((beta + math.sqrt(n[c])) / alpha + l2)
    for _ in range(3):
        for row, label in zip(rows, y, strict=True):
            w = {c: weight(c) for c in row}
            p = 1 / (1 + math.exp(-sum(w[c] * v for c, v in row.items())))
            for c, v in row.items():
                g = (p - label) * v
                z[c] += g - (math.sqrt(n[c] + g * g) - math.sqrt(n[c])) / alpha * w[c]
                n[c] += g * g
    got = quality_classifier.train_ftrl(quality_classifier.examples_of([t.encode() for t in texts], bits), np.array(y, float), bits)
    assert all(math.isclose(got[c], weight(c), rel_tol=1e-3, abs_tol=1e-4) for row in rows for c in row)


def test_quality_classifier_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = quality_classifier.op1_quality_classifier(spark, sf).collect()
    held = [r for r in out if r.held_out and label.get(r.doc_id) is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out) and len(held) > 40
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.95 * len(held)


def test_phrases_of_whole_texts():
    """Stretches of eight bytes, put together, give the plain greedy parse, for bytes that the data lacks too."""
    rnd = random.Random(2)
    for trial in range(40):
        data = bytes(rnd.choices(b"abc ", k=rnd.randint(5, 300)))
        classes = np.zeros(256, np.uint8)
        classes[list(b"abc ")] = [1, 2, 3, 4]
        table = language_id.parse_table(data, classes.tobytes(), 5)
        texts = [bytes(rnd.choices(b"abc d", weights=[5, 5, 1, 2, trial % 2], k=rnd.choice([0, 1, 7, 8, 9, 30, 200, 500]))) for _ in range(12)]
        assert language_id.count_phrases(texts, [table], classes, 5, 8)[0].tolist() == [language_id.phrases(data, t) for t in texts]


def test_language_id(spark, docs, odd, none):
    samples = language_id.learn_languages(docs)
    assert all(len(t) <= language_id.SAMPLE_BYTES for t in samples.values())
    for r in language_id.predict_languages(docs.limit(40), samples).collect():  # the plain parse of each language
        text = docs.where(docs.doc_id == r.doc_id).select(language_id._normal(docs.text)).first()[0].encode()
        n = {k: language_id.phrases(v, text) for k, v in samples.items()} if len(text) < 3000 else None
        assert n is None or (r.lang_pred == min(n, key=lambda k: (n[k], k)) and math.isclose(r.score, sorted(n.values())[1] / sum(sorted(n.values())[:2])))
    got = [(r.doc_id, r.lang_pred) for r in language_id.predict_languages(odd.withColumnRenamed("source", "score"), samples).collect()]
    assert [x for i, x in got if i in (1, 2, 3)] == ["und"] * 3 and len(got) == len(ODD)
    assert language_id.predict_languages(none, samples).count() == 0 and {r.lang_pred for r in language_id.predict_languages(docs, language_id.learn_languages(none.withColumnRenamed("source", "lang"))).collect()} == {"und"}
    many = {f"l{k:03}": t for k in range(100) for t in [f"word{k} " * 3000]}
    rows = spark.createDataFrame([(k, t, la) for k, (la, t) in enumerate(many.items())], "doc_id long, text string, lang string")
    small = language_id.learn_languages(rows, table_bytes=1 << 20)
    assert len(small) == 100 and sum(len(t) for t in small.values()) * 8 * 6 <= 1 << 20
    marks = spark.createDataFrame([(1, "\u0939\u093f\u0928\u094d\u0926\u0940 \u092d\u093e\u0937\u093e", None), (2, "123 \u0301", None)], "doc_id long, text string, lang string")
    assert [r[0] for r in marks.select(language_id._normal(marks.text)).collect()] == [marks.first().text, ""]


def test_language_id_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in language_id.op7_language_id(spark, sf).collect() if r.held_out]
    assert len(held) > 150 and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies.</div>
<main><article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>,
 second.<p>Two&nbsp;words <a href="/x>y">link</a>.<!-- <p>no</p> --><form><input> Name</form><aside class=sidebar>Side</aside><script>var x = "</p>";</script><div class="ad">Buy!</div><blockquote>Said.</blockquote></article>
<section id="comments"><p>Nice article, well done, thanks.</p></section></main><footer>&copy; 2024</footer></body></html>"""


def test_html(spark):
    assert html_extract.main_text(PAGE) == "Title & more\nFirst bold, second.\nTwo words link.\nSaid."
    bare = "<html><body><ul><li><a>Home</a></li><li><a>News</a></li></ul><div><p>A long paragraph of text, with marks, that goes on and on, and ends.</p><p>Another long one, with marks too, that also goes on for some time.</p></div><footer>x</footer></body></html>"
    assert html_extract.main_text(bare).count("\n") == 1
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p>") == "" and html_extract.main_text("just text") == "just text"
    df = spark.createDataFrame([(1, "u", None), (1, "u", PAGE), (2, None, "<p>" * 3000 + "deep")], "page_id long, url string, html string")
    out = html_extract.extract_text(df).collect()
    assert [r.n_chars for r in out] == [0, len(html_extract.main_text(PAGE)), 4] and html_extract.extract_text(df.limit(0)).count() == 0


def test_html_article_is_a_teaser():
    para = "A long paragraph of the story, with several marks, that goes on for quite some time, and then, at last, ends."
    page = f"""<body><article class="card"><h3>Other</h3><p>Read on here</p></article><div class="post"><h1>Title</h1><p>{para}</p><h2>Part two</h2><p>{para}</p><p>Short</p><p>{para}</p></div></body>"""
    assert html_extract.main_text(page).split("\n") == ["Title", para, "Part two", para, "Short", para]
    lists = f"<body><main><div><ul><li>One</li><li>Two</li><li>Three</li></ul></div><section><h1>Title</h1><p>{para}</p><p>{para}</p></section></main></body>"
    assert html_extract.main_text(lists).split("\n") == ["Title", para, para]


PARA = "A long paragraph of the story, with several marks, that goes on for quite some time, and then, at last, ends."


@pytest.mark.parametrize(
    "inner,want",
    [
        ('<p>See <a href="/hidden-valley">the valley</a> and <a href="/x?id=ad">this</a>.</p>', ["See the valley and this."]),
        ('<div title="A hidden gem"><p>in div</p></div>', ["in div"]),
        ('<div data-hidden="false">shown</div><div hidden>gone</div>', ["shown"]),
        ('<div class="layout has-sidebar">a</div><div class="side-by-side">b</div><div class="site-nav">c</div>', ["a", "b"]),
        ("<p>a <span class=ad><span>x</span>leak</span> b</p>", ["a b"]),
        ("<p>x <math><mi>y</mi><mo>=</mo><mn>2</mn></math> z</p>", ["x y=2 z"]),
        ('<p>open <a href="x>quote</a> here</p>', ["open quote here"]),
        ('<p>text <span class="ad">Buy<p>next', ["text", "next"]),
        ("<ul><li>one<li>two<ul><li>in</ul><li>three</ul>", ["one", "two", "in", "three"]),
        ("<p>5 < 6 &amp; 7 > 3 <3</p>", ["5 < 6 & 7 > 3 <3"]),
        ('<div class="comment-list"><p>Nice one, really, thanks.</p></div>', []),
    ],
)
def test_html_contract(inner, want):
    page = f"<html><body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>{PARA}</p>{inner}<p>{PARA}</p></article></body></html>"
    assert html_extract.main_text(page).split("\n")[2:-1] == want


@pytest.mark.parametrize("unit", ["<a ", "<div>x", "<!--", "<script>", "<p>", "<ul><li>x", "<span class=ad>", "<", "</script ", '<a b="', "<p><b>"])
def test_html_is_linear(unit):
    import time

    t = time.process_time()
    html_extract.main_text(unit * (300_000 // len(unit)))
    assert time.process_time() - t < 6


def test_html_against_brute_force(spark):
    """Every page of the table: the blocks of its article, cut by plain expressions."""
    import html
    import re

    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.op6_html_extract(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    for r in rows:
        body = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split("</?(?:p|h1)>", body)]
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id] == (want, len(want))
    assert len(got) == len(rows)
    assert any(html_extract.main_text(r.html, share=5.0) != got[r.page_id][0] for r in rows)


def test_curriculum_hot_id_and_names(spark):
    """A null or repeated id is dealt by text, and columns named as inner or result ones don't clash."""
    docs = spark.createDataFrame([(None if i % 2 else 7, "w " * (1 + i % 5) + str(i), "a", i, i) for i in range(300)], "doc_id long, text string, source string, size long, key long")
    from pyspark.sql import functions as F

    out = curriculum_mix.training_order(docs, keep=("text", "size", "key"))
    assert sorted(r.key for r in out.where("copy = 0").collect()) == list(range(300)) and out.columns.count("size") == 1
    placed = curriculum_mix._placed(docs, "text", curriculum_mix.WEIGHTS, curriculum_mix.RAMPS, 3.0, 3, ("text",))
    starts = [r.p for r in placed.select(F.get("positions", F.lit(0)).alias("p")).collect()]
    assert len(set(starts)) == 300


def test_training_order_places_every_copy(spark):
    docs = spark.createDataFrame([(i, "x " * (1 + i % 7), "a" if i % 5 == 0 else "b") for i in range(400)], SCHEMA)
    mixed = {r.doc_id: r for r in curriculum_mix.mix_sources(docs).collect()}
    rows = curriculum_mix.training_order(docs).collect()
    assert collections.Counter(r.doc_id for r in rows) == {i: r.copies for i, r in mixed.items() if r.copies} and max(r.copies for r in rows) == 3
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    for r in rows:
        assert r.position == mixed[r.doc_id].positions[r.copy] and (r.copy > 0 or r.position == mixed[r.doc_id].position)
    # Words placed up to t are the demand's integral: ramp 1.5 to 0.5 for the first source, flat for the second.
    for source, upto in (("a", lambda t: 1.5 * t - t * t / 2), ("b", lambda t: t)):
        target = next(r.target for r in rows if r.source == source)
        for t in (0.1, 0.3, 0.5, 0.7, 0.9, 1.0):
            assert abs(sum(r.size for r in rows if r.source == source and r.position <= t) - target * upto(t)) <= 7


def test_decontaminate_beyond_the_radius(spark):
    rnd = random.Random(11)
    items, rows = [], []
    for k in range(60):  # 80 words: 76 shingles; 8 new words at the end leave 68 of 84, over 0.8
        w = [f"i{k}x{rnd.randint(0, 10**6)}" for _ in range(80)]
        items.append((k, " ".join(w)))
        rows.append((k, " ".join([f"n{rnd.randint(0, 10**6)}" for _ in range(20)] + w[:72] + [f"n{rnd.randint(0, 10**6)}" for _ in range(30)])))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(k, k) for k in range(60)}
    assert {r.similarity for r in found} == {68 / 84} and max(r.hamming for r in found) > decontaminate.RADIUS


def test_near_dup_first_band_of_full_values(spark):
    """Band 0 is equal in the low 16 bits only: the pair shares the other bands' buckets, and is compared there."""
    x = np.arange(1, 126, dtype=np.uint32) * np.uint32(1_000_003)
    y = x.copy()
    y[:5] += np.uint32(1 << 16)
    classes = spark.createDataFrame([(1, 1, bytearray(x.tobytes())), (2, 2, bytearray(y.tobytes()))], "cls long, rep long, sig binary")
    dealt = near_dup._dealt(near_dup._members(classes, 25, 5), 256)
    pairs = dealt.mapInArrow(near_dup._compare(85, 100, 1e-6, 25, 5, False), "a long, b long").collect()
    assert [(r.a, r.b) for r in pairs] == [(1, 2)]


@pytest.mark.parametrize("length", [20, 57, 120, 200])
def test_decontaminate_recall_with_edits(spark, length):
    """Windows of similarity 0.8 or more, edited at random places and at either end: all are found. Others aren't."""
    rnd = random.Random(length)
    noise = lambda n: [f"n{rnd.randint(0, 10**7)}" for _ in range(n)]
    items, rows, want = [], [], set()
    sh = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    for k in range(40):
        w = [f"i{rnd.randint(0, 300)}" for _ in range(length)]
        items.append((k, " ".join(w)))
        edit, n = k % 3, rnd.randint(0, length // 8)
        v = edits(w, min(n, max(1, length // 40)), rnd) if edit == 0 else w[: length - n] + noise(n) if edit == 1 else noise(n) + w[n:]
        rows.append((k, " ".join(noise(15) + v + noise(25))))
    for (d, t), (_, w) in zip(rows, items, strict=True):
        t, a = t.split(), sh(w.split())
        best = max(sum((a & b).values()) / sum((a | b).values()) for i in range(len(t) - length + 1) for b in [sh(t[i : i + length])])
        want |= {(d, d)} if best >= 0.8 else set()
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, t) for k, t in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == want and len(want) > 10


def test_neighbours_hold_every_fingerprint_within_the_radius(spark):
    rnd = random.Random(1)
    rows = []
    for _ in range(300):
        a, b = rnd.getrandbits(64), 0
        for bit in rnd.sample(range(64), 11):
            b |= 1 << bit
        sign = lambda x: x - (1 << 64) if x >> 63 else x
        rows.append((sign(a), sign(a ^ b)))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "a long, b long")
    shared = F.size(F.array_intersect(decontaminate._blocks(F.col("a")), decontaminate._neighbours(F.col("b"), 11)))
    assert df.where(shared == 0).count() == 0


def test_decontaminate_rows_of_one_id(spark):
    item = " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "clean words " * 9, "x"), (1, "lead " + item + " end", "y"), (None, item, "z")], "doc_id long, text string, w string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.decontaminate(docs, bench).collect()] == [(1, "clean words " * 9, "x")]
    assert {r.doc_id for r in decontaminate.find_leaks(docs.withColumnRenamed("w", "n"), bench).collect()} == {1, None}
