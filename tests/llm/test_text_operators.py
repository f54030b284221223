"""Operators on single texts: decontamination, secrets, licenses, language, quality, language model, against plain versions."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shutterloom.llm import decontaminate, langid, licenses, lm, quality, secrets

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 800
#: null and empty texts, null columns, repeated rows, one id with two texts, a very long text, characters beyond the BMP
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id here", "en", "a", 10), (3, "twice", "en", "a", 5), (3, "twice", "en", "a", 5), (3, "other", "en", "a", 5), (4, LONG, "en", "b", len(LONG)), (5, "\U0001f600 é \t\n", None, "c", 4)]


def docs(spark, rows=(), extra=False):
    df = spark.createDataFrame([*ODD, *rows], DOCS)
    return df.withColumn("_text", F.lit("x")).withColumn("found", F.lit(1)).withColumn("_id", F.lit(2)) if extra else df


def word_list(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_decontamination_against_all_windows(spark):
    rng = np.random.default_rng(1)
    vocab = ["a", "b", "c", "É", "d9"]
    items = [(i, " ".join(rng.choice(vocab, rng.integers(1, 16)))) for i in range(30)] + [(90, None), (91, ""), (92, "the quick brown"), (7, items_text := "one two three four five six seven eight nine ten eleven")]
    texts = [" ".join(rng.choice(vocab, rng.integers(0, 120))) for _ in range(40)] + [f"x {items_text.upper()} y", "THE  quick, brown."]
    rows = [(100 + i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (10**6, 40):  # one block of items, and several
        got = {(r.doc_id, r.n_words): r for r in decontaminate.report(docs(spark, rows, True), bench, block_words=block).collect()}
        for doc, text in [(r[0], r[1]) for r in [*ODD, *rows]]:
            w, hit, found = word_list(text), set(), set()
            for item, t in items:
                iw = word_list(t)
                n = min(10, len(iw))
                for k in range(len(iw) - n + 1 if n else 0):
                    for i in range(len(w) - n + 1):
                        if w[i : i + n] == iw[k : k + n]:
                            hit |= set(range(i, i + n))
                            found.add(str(item))
            r = got[doc, len(w)]
            assert (r.n_hit, r.n_items, r.contaminated) == (len(hit), len(found), bool(hit)), (doc, block)
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    cut = {r.doc_id: r for r in decontaminate.remove(docs(spark, rows), bench.where("item_id in (7, 92) and length(text) > 10"), max_coverage=0.9).where("doc_id >= 140").collect()}
    assert cut[140].text == "x  y" and cut[140].n_chars == 4 and 141 not in cut
    assert decontaminate.remove(docs(spark), bench.limit(0)).count() == len(ODD) and decontaminate.report(docs(spark).limit(0), bench).count() == 0


def test_decontamination_by_several_blocks_is_that_by_one(spark):
    w = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    # two items that overlap in a document, and two that each hit 45 % of one
    bench = spark.createDataFrame([(1, w(0, 14)), (2, w(8, 22)), (3, w(100, 118)), (4, w(200, 218))], "item_id bigint, text string")
    texts = [f"x {w(0, 22)} " + "y " * 40, f"{w(100, 118)} {w(200, 218)} a b c d", "clean text", "", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] * 2  # repeated rows have a row each
    df = spark.createDataFrame(rows, DOCS)
    order = lambda rs: sorted(map(tuple, rs), key=str)
    one, several = (order(decontaminate.report(df, bench, block_words=b).collect()) for b in (10**6, 15))
    assert several == one and len(one) == len(rows)
    one, several = (order(decontaminate.remove(df, bench, block_words=b).collect()) for b in (10**6, 15))
    assert several == one and len(one) == len(rows) - 2


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def test_secret_base_spans_and_markov(spark):
    key = "Zk3xQ9vT1mB7wLr0Jd8sYp2N"
    cases = ["token=abc", "secret=token : abcdefg", "x API_KEY: 'a1b2c3d4' \U0001f600 Token=\"zzzzzz\"", "AKIA" + "Q" * 16 + " AKIAshort", "AKIA" * 6, "f" * 24 + " " + "0" * 23 + "g" + "a" * 30, f"see {key} there", "ordinaryidentifiername_with_words", "password = passwd=123456"]
    rows = [(200 + i, t, "en", "s", len(t)) for i, t in enumerate(cases)]
    names = ["ordinary_identifier", "name_with_some_words", "identifiername", "wordsandnames", "another_ordinary_name", "readwordsfile", "in_order"]
    samples = secrets.generated_samples(spark).union(spark.createDataFrame([(n, 0) for n in names * 20] + [(None, 0), ("x", None), ("", 1)], "text string, label int"))
    got = {(r.doc_id, r.base_sha256): r for r in secrets.report(docs(spark, rows, True), samples).collect()}
    for doc, text in [(r[0], r[1] or "") for r in [*ODD, *rows]]:
        base = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        r = got[doc, hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(base)).encode()).hexdigest()]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, _, _, kind in base) for k in ("assign", "access", "hex"))
    assert [r.spans for r in got.values() if r.doc_id == 206] == ["markov:4:28"] and [r.spans for r in got.values() if r.doc_id == 207] == [""]
    clean = {r.doc_id: r for r in secrets.redact(docs(spark, rows), samples).where("doc_id >= 200").collect()}
    assert clean[206].text == "see [SECRET] there" and clean[206].n_chars == 18 and clean[200].text == "token=abc"
    assert secrets.redact(docs(spark).limit(0)).count() == 0


def test_random_strings_are_told_from_identifiers(spark):
    """Precision and recall of the Markov models at the default threshold, on strings that taught nothing."""
    rng = np.random.default_rng(13)
    signs = ("0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    secret = lambda: "".join(rng.choice(list(signs[int(rng.integers(3))]), int(rng.integers(24, 48))))
    words = [w for w in speech("en", 400, rng).split() + speech("fr", 200, rng).split() if w.isascii() and len(w) > 3]
    name = lambda: str(rng.choice(["_", "-", ""])).join(rng.choice(words, 6))
    taught = spark.createDataFrame([(" ".join(rng.choice(words, 3)), 0) for _ in range(400)], "text string, label int")
    taught = secrets.generated_samples(spark).unionByName(secrets.identifier_samples(taught.select(F.monotonically_increasing_id().alias("doc_id"), "text")))
    # random strings that the fixed shapes would find are left out
    drawn = [x for x in (secret() for _ in range(400)) if not re.search("[0-9a-f]{24,}|AKIA", x)]
    rows = [(i, f"see {x} there") for i, x in enumerate(drawn)] + [(10_000 + i, f"see {name()[:60]} there") for i in range(400)]
    got = {r.doc_id: r.n_markov for r in secrets.report(spark.createDataFrame(rows, "doc_id long, text string"), taught).collect()}
    found, wrong = sum(n for i, n in got.items() if i < 10_000), sum(n for i, n in got.items() if i >= 10_000)
    assert found >= 0.95 * len(drawn) and found >= 0.97 * (found + wrong)


def test_licenses(spark):
    cases = ["Licensed under CC BY-NC 4.0. All rights reserved.", "GNU General Public License, version 3. cc by, CC-BY", "all rights  reserved all Rights reserved", "Released under the MIT License", "mit der Zeit", "general public", "K general public license"]
    rows = [(300 + i, t, "en", "s", len(t)) for i, t in enumerate(cases)]
    got = {(r.doc_id, r.n_words): r for r in licenses.report(docs(spark, rows, True)).collect()}
    for doc, text in [(r[0], r[1]) for r in [*ODD, *rows]]:
        w = word_list(text)
        at = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        r = got[doc, len(w)]
        assert (r.n_base, r.first_word, r.last_word) == (len(at), min(at, default=(None,))[0], max(at, default=(None,))[0]), doc
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    by_id = {k[0]: r for k, r in got.items()}
    assert by_id[300].labels == "cc-by,cc-by-nc,reserved" and by_id[303].labels == "mit" and by_id[304].labels == "" and by_id[301].labels == "cc-by,gpl"
    assert len(licenses.rules()) > 200


def strings_of(tree):
    """Strings of every branch of a parsed pattern: what may be left out is there and not, loops go round up to twice."""
    made = [""]
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            parts = [chr(arg)]
        elif op == "IN":
            parts = [chr(x[1] if str(x[0]) == "LITERAL" else x[1][0]) for x in arg]
        elif op == "BRANCH":
            parts = [s for branch in arg[1] for s in strings_of(branch)]
        elif op == "SUBPATTERN":
            parts = strings_of(arg[3])
        elif op == "MAX_REPEAT":
            inner = strings_of(arg[2])
            parts = ["".join(x) for n in sorted({arg[0], min(arg[1], arg[0] + 1), min(arg[1], 2)}) for x in itertools.product(inner, repeat=n)]
        else:
            assert op in ("ASSERT", "ASSERT_NOT"), op
            continue
        made = [a + b for a in made for b in parts]
    return made


def test_license_keywords_and_gate_cut_no_rule():
    gate = re.compile(licenses.GATE)
    for _, label, _, keyword, pattern in licenses.rules():
        cases = [f" {s} " for s in strings_of(re._parser.parse(pattern))]
        assert cases
        for s in cases:
            assert re.search(pattern, s) and keyword in s and gate.search(s), (label, keyword, pattern, s)


def test_license_rules_against_plain_ones(spark):
    """Labels by Python's regular expressions over all rules, with suppression by priority and containment."""
    rng = np.random.default_rng(10)
    every = [s for r in licenses.rules() for s in strings_of(re._parser.parse(r[4]))[:2]]
    texts = [" ".join(str(rng.choice(every)) if rng.random() < 0.3 else str(rng.choice(["some", "words", "license", "gpl", "2 0", "cc by", "the"])) for _ in range(14)) for _ in range(60)]
    got = {r.doc_id: r for r in licenses.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        norm = f" {' '.join(word_list(text))} "
        found = [(p, label, conf, m.start(), m.end()) for p, label, conf, _, pattern in licenses.rules() for m in re.finditer(pattern, norm)]
        kept = sorted(x for x in found if not any(y[3] <= x[3] and x[4] <= y[4] and y[0] < x[0] for y in found))
        assert got[i].detections == ",".join(f"{label}:{a}:{b}" for _, label, _, a, b in kept), text
        base = {label for phrase, label in licenses.BASE if f" {phrase} " in norm}
        assert got[i].labels == ",".join(sorted(base | {x[1] for x in kept}))


def test_licenses_forbidding_copies(spark):
    cases = ["It may not be reproduced without prior written permission.", "This may not be copied without permission", "may not be used without express written permission", "see creativecommons.org/publicdomain/zero"]
    rows = [(i, t) for i, t in enumerate(cases)]
    got = {r.doc_id: r.labels for r in licenses.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: "proprietary", 1: "proprietary", 2: "proprietary", 3: "cc0"}


def speech(lang, n, rng):
    parts = {"en": ["th", "er", "on", "ing", "the"], "fr": ["eau", "oi", "é", "que", "ent"], "de": ["sch", "ung", "ü", "der", "ein"]}[lang]
    return " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(n))


@pytest.mark.parametrize("langs", [("en", "fr", "de"), ("en",), ()])
def test_language_id(spark, langs):
    rng = np.random.default_rng(2)
    rows = [(i, speech(x, 60, rng), x, "s", 0) for i, x in enumerate(langs * 20)]
    train = spark.createDataFrame(rows, DOCS)
    model = langid.fit(train, per_language=15)
    assert model.langs == sorted(langs)
    got = langid.predict(docs(spark, rows, True), model).where("text is not null").collect()
    right = [r.lang_pred == r.lang for r in got if r.doc_id is not None and r.source == "s"]
    assert all(right) and all(0 <= r.lang_score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.text in ("", " ")} <= {"und"}
    assert langid.has_letter("é".encode()) and not langid.has_letter("12 \U0001f600".encode())


def test_the_language_sample_is_that_of_the_smallest_hashes(spark):
    rows = [(i, f"text {i}", "en" if i % 50 else "fr") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    model, langid.model = langid.model, lambda sums: seen.update(sums)  # noqa: B023
    try:
        langid.fit(df, per_language=100)
    finally:
        langid.model = model
    hashed = sorted((r.h, r.doc_id, r.lang) for r in df.select(F.xxhash64("doc_id").alias("h"), "doc_id", "lang").collect())
    for lang in ("en", "fr"):
        ids = [i for _, i, x in hashed if x == lang][:100]
        assert (seen[lang] == sum(langid.trigrams(f"text {i}".encode()) for i in ids)).all()


def test_language_decoding_against_a_plain_one(spark):
    """Each bit by naive Bayes written out, each codeword's weighted logistic loss, the least loss."""
    rng = np.random.default_rng(12)
    rows = [(i, speech(x, 12, rng), x, "s", 0) for i, x in enumerate(("en", "fr", "de") * 30)]
    df = docs(spark, rows)
    fitted = langid.fit(df.where("doc_id < 60 and source = 's'"))
    sums = {x: sum(langid.trigrams(r[1].encode()) for r in rows[:60] if r[2] == x) for x in ("de", "en", "fr")}
    p = {x: (c + 0.5) / (c.sum() + 0.5 * langid.BUCKETS) for x, c in sums.items()}
    code = langid.codewords(3)
    right = 0
    for i, text, lang, *_ in rows[60:]:
        c = langid.trigrams(text.encode())
        losses = []
        margins = []
        for bit in range(code.shape[1]):
            ones, zeros = ([p[x] for x, b in zip(sorted(p), code[:, bit], strict=True) if b == side] for side in (1, -1))
            margins.append(float((c * (np.log(np.mean(ones, axis=0)) - np.log(np.mean(zeros, axis=0)))).sum() / math.sqrt(c.sum())))
        for k in range(3):
            losses.append(sum(w * math.log1p(math.exp(-max(-50, min(50, m * b)))) for w, m, b in zip(fitted.bit_weight, margins, code[k], strict=True)))
        want = sorted(p)[int(np.argmin(losses))]
        found, score, _ = fitted.predict(text.encode())
        assert found == want and abs(score - 1 / sum(math.exp(min(losses) - x) for x in losses)) < 1e-9
        right += found == lang
    assert right >= 29


def test_codewords_are_apart():
    for n in (2, 4, 7, 40):
        code = langid.codewords(n)
        assert len({tuple(x) for x in code}) == n and (np.abs(code.sum(0)) < n).all()


def test_quality(spark):
    good, bad = "Plain words stand here. They end in stops.\n", "### a|b $$$ c|d %%% e|f\n"
    rows = [(1000 + i, (bad if i % 4 == 0 else good) * (2 + i % 3), "en", f"h{i % 5}", 0) for i in range(120)]
    labels = spark.createDataFrame([(1000 + i, int(i % 4 != 0)) for i in range(80)] + [(1, None), (2, 7), (None, 1)], "doc_id bigint, quality int")
    got = quality.classify(docs(spark, rows, True), labels).collect()
    assert len(got) == len(ODD) + 120 and all(0 <= r.score <= 1 and 0 < r.path_rate < 1 for r in got)
    assert all(r.keep == ((r.doc_id - 1000) % 4 != 0) for r in got if r.doc_id is not None and r.doc_id >= 1000)
    none = quality.classify(docs(spark), labels.limit(0)).collect()
    assert len(none) == len(ODD) and {round(r.score, 6) for r in none} == {0.5}
    assert quality.classify(docs(spark).limit(0), labels).count() == 0


def test_quality_rates_against_plain_ones(spark):
    """Empirical Bayes rates of many sparse hosts and paths, worked out in Python from the evidence that the operator gives."""
    rng = np.random.default_rng(9)
    good, bad = "Plain words stand here. They end in stops.\n", "### a|b $$$ c|d %%% e|f\n"
    rows = [(i, good if rng.random() < (0.9 if i % 7 else 0.1) else bad, f"p{i % 3}", f"h{int(rng.integers(40)) if i % 3 else 0}", 0) for i in range(400)]
    labels = {i: int(r[1] == good) for i, r in enumerate(rows) if i % 2}
    got = {r.doc_id: r for r in quality.classify(spark.createDataFrame(rows, DOCS), spark.createDataFrame(list(labels.items()), "doc_id bigint, quality int")).collect()}
    base = min(max(sum(labels.values()) / len(labels), 0.01), 0.99)
    chance = {i: labels.get(i, 1 / (1 + math.exp(-(r.evidence + math.log(base / (1 - base)))))) for i, r in got.items()}

    def totals(key):
        made = {}
        for i, r in got.items():
            n, s = made.get(key(r), (0, 0.0))
            made[key(r)] = n + 1, s + chance[i]
        return made

    def strength(groups, prior):
        n = sum(x for x, _ in groups.values())
        noise = sum(x * prior(k) * (1 - prior(k)) for k, (x, _) in groups.items()) / n
        spread = sum(x * (s / x - prior(k)) ** 2 for k, (x, s) in groups.items()) / n - noise * len(groups) / n
        return min(quality.STRONGEST, max(quality.WEAKEST, noise / max(spread, 1e-9)))

    hosts, paths = totals(lambda r: r.host), totals(lambda r: (r.host, r.path))
    mean = sum(chance.values()) / len(chance)
    k = strength(hosts, lambda _: mean)
    host_rate = {h: (s + mean * k) / (n + k) for h, (n, s) in hosts.items()}
    k = strength(paths, lambda x: host_rate[x[0]])
    path_rate = {x: (s + host_rate[x[0]] * k) / (n + k) for x, (n, s) in paths.items()}
    for r in got.values():
        want = path_rate[r.host, r.path]
        assert abs(r.host_rate - host_rate[r.host]) < 1e-9 and abs(r.path_rate - min(0.999, max(0.001, want))) < 1e-9
        assert abs(r.score - 1 / (1 + math.exp(-(r.evidence + math.log(r.path_rate / (1 - r.path_rate)))))) < 1e-9
    sparse = min(hosts, key=lambda h: hosts[h][0])
    own = hosts[sparse][1] / hosts[sparse][0]
    assert abs(host_rate[sparse] - mean) < abs(own - mean)  # shrunk towards the global prior


def area(scores, truth):
    """The share of pairs of a good and a bad document that the scores order rightly."""
    good, bad = ([s for s, t in zip(scores, truth, strict=True) if t == x] for x in (1, 0))
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def test_quality_of_held_out_documents_on_sparse_hosts(spark):
    """Words decide, hosts help, and shrunk rates of hosts with few documents beat their own rates."""
    rng = np.random.default_rng(4)
    rows, truth = [], {}
    for i in range(3000):
        host = int(rng.integers(400))
        good = rng.random() < (0.85 if host % 2 else 0.15)
        words = [("w%d" if rng.random() < (0.6 if good else 0.4) else "v%d") % rng.integers(300) for _ in range(12)]
        rows.append((i, " ".join(words), "p", f"h{host}", 0))
        truth[i] = int(good)
    labels = spark.createDataFrame(list(truth.items()), "doc_id bigint, quality int")
    got = quality.classify(spark.createDataFrame(rows, DOCS), labels, teaches=F.col("doc_id") % 3 != 0).collect()
    held = [r for r in got if r.doc_id % 3 == 0]
    seen = Counter()
    for i, _, _, host, _ in rows:
        if i % 3:
            seen[host] += 1
            seen[host, 1] += truth[i]
    own = [min(0.999, max(0.001, seen[r.host, 1] / seen[r.host] if seen[r.host] else 0.5)) for r in held]
    t = [truth[r.doc_id] for r in held]
    loss = lambda p: -sum(math.log(x if y else 1 - x) for x, y in zip(p, t, strict=True)) / len(t)
    raw = [1 / (1 + math.exp(-(r.evidence + math.log(o / (1 - o))))) for r, o in zip(held, own, strict=True)]
    assert loss([r.score for r in held]) < loss(raw) - 0.02  # shrunk rates, against each host's own
    assert area([r.score for r in held], t) > area([r.evidence for r in held], t) + 0.05 > 0.65  # hosts help, words do too
    assert area([r.evidence for r in held], t) > 0.65
    # what is held out teaches nothing
    other = spark.createDataFrame([(i, 1 - q if i % 3 == 0 else q) for i, q in truth.items()], "doc_id bigint, quality int")
    again = quality.classify(spark.createDataFrame(rows, DOCS), other, teaches=F.col("doc_id") % 3 != 0).collect()
    assert {r.doc_id: round(r.score, 9) for r in again} == {r.doc_id: round(r.score, 9) for r in got}


@pytest.mark.parametrize(("head", "paired", "contexts"), [(300_000, 32_768, 255), (40, 5, 9), (3, 3, 9)])
def test_language_model(spark, head, paired, contexts):
    rng = np.random.default_rng(3)
    rows = [(2000 + i, speech("en", 40, rng), "en", "s", 0) for i in range(60)]
    df = docs(spark, rows, True)
    held = langid.held_out(10, 0)
    got = lm.score(df, ~held, sweeps=2, head=head, paired=paired, contexts=contexts).collect()
    every = [*ODD, *rows]
    counts = Counter()
    toks = lambda t: [*(t or "").encode().lower().split(), b" "]
    for r in every:
        if r[0] is None or zlib.crc32(str(r[0]).encode()) % 10:
            counts.update(toks(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = sorted((r[0] or -1, len(toks(r[1])), sum(counts[w] > 0 for w in toks(r[1])), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(r[1])), 6)) for r in every)
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(-1e9 < r.score < 0 for r in got)
    assert lm.score(df.limit(0), ~held).count() == 0


def test_language_model_predicts_what_its_restaurants_say(spark):
    """Scores by brute force from the fitted counts, the same by broadcast and by join; each context's predictions sum to one."""
    rng = np.random.default_rng(5)
    rows = [(i, speech("en", 40, rng)) for i in range(50)] + [(100, None), (101, "the of nowhere the"), (102, rows_text := speech("en", 20, rng)), (102, rows_text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit("x")).withColumn("lang", F.lit(None))
    train = F.col("doc_id") < 50
    scored = [sorted((r.doc_id, round(r.score, 6)) for r in lm.score(df, train, sweeps=2, head=h, paired=p, contexts=9).collect()) for h, p in ((300_000, 32_768), (60, 5), (0, 0))]
    assert scored[0] == scored[1] == scored[2]
    model = lm.fit(df.select(F.coalesce("text", F.lit("")).alias("_text"), train.alias("_train")), sweeps=2, contexts=9)
    table = {bytes(r._token): r for r in model.words.collect()}
    alone = {w: 10**r._lp for w, r in table.items()}
    own = {(c, w): o for w, r in table.items() for c, o in zip(r._ctxs, r._owns, strict=True)}
    known = sum(alone.values())
    assert known < 1
    for c in range(len(model.contexts)):
        assert abs(sum(o for (x, _), o in own.items() if x == c) + model.back[c] - 1) < 1e-9
    want = []
    for i, t in rows:
        ws, total, before = [*lm.tokens((t or "").encode()), lm.END], 0.0, lm.END
        for w in ws:
            c = model.contexts.index(before) if before in model.contexts else None
            total += math.log10(alone[w] if c is None else own.get((c, w), 0.0) + model.back[c] * alone[w])
            before = w
        want.append((i, round(total, 6)))
    assert scored[0] == sorted(want)


def test_context_restaurants_beat_single_words(spark):
    """Held-out texts of a language in which each word tells the next."""
    rng = np.random.default_rng(6)
    names = [f"w{i}" for i in range(12)]

    def text():
        w, out = int(rng.integers(12)), []
        for _ in range(30):
            out.append(names[w])
            w = (w * 5 + int(rng.integers(2))) % 12
        return " ".join(out)

    df = spark.createDataFrame([(i, text()) for i in range(200)], "doc_id long, text string")
    found = {c: lm.score(df, F.col("doc_id") < 150, sweeps=2, contexts=c).where("doc_id >= 150").agg(F.sum("score"), F.sum("base_score")).first() for c in (0, 20)}
    assert found[20][0] > 0.6 * found[0][0]  # both are below zero
    assert found[20][0] > found[20][1]


def test_every_word_is_a_context(spark):
    """More words than 255, each of which tells the next; scores by brute force from the fitted counts, by broadcast and by join."""
    names = [f"w{i}" for i in range(400)]
    after = lambda w: (w * 7 + 1) % 400
    rows = []
    for i in range(1200):
        w, out = i % 400, []
        for _ in range(4):
            out.append(names[w])
            w = after(w)
        rows.append((i, " ".join(out)))
    rows += [(2000 + w, f"{names[w]} {names[after(w)]}") for w in range(400)] + [(3000 + w, f"{names[w]} {names[after(w + 1)]}") for w in range(400)] + [(4000, "unseen w1 unseen unseen"), (4001, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = F.col("doc_id") < 1200
    scored = [{r.doc_id: round(r.score, 6) for r in lm.score(df, train, sweeps=1, head=h, paired=p).collect()} for h, p in ((300_000, 32_768), (100, 20))]
    assert scored[0] == scored[1]
    assert all(scored[0][2000 + w] > scored[0][3000 + w] + 0.5 for w in range(400))
    model = lm.fit(df.select(F.coalesce("text", F.lit("")).alias("_text"), train.alias("_train")), sweeps=1)
    table = {r._key: r for r in model.table.collect()}
    own = {(r._ctx, r._word): r._own for r in model.pairs.collect()}
    sums = Counter()
    for (c, _), o in own.items():
        sums[c] += o
    assert len(sums) == 401 and all(abs(s + table[c]._back - 1) < 1e-9 for c, s in sums.items())
    for i, t in rows:
        ws = lm.hashed([lm.END, *lm.tokens((t or "").encode()), lm.END]).tolist()
        want = sum(math.log10(own.get((c, w), 0.0) + table[c]._back * 10 ** table[w]._lp) for c, w in zip(ws, ws[1:], strict=False))
        assert abs(scored[0][i] - want) < 1e-5


def test_language_model_joins_broadcast_only_the_hottest_words(spark, monkeypatch):
    """The driver builds what joins broadcast, so that has a bound of its own, far below the words that Python tasks number."""
    words = [f"w{i}" for i in range(300)]
    df = spark.createDataFrame([(i, " ".join(words[(i * 7 + k * k) % 300] for k in range(6))) for i in range(400)], "doc_id long, text string")
    want = {r.doc_id: round(r.score, 6) for r in lm.score(df, F.col("doc_id") < 300, sweeps=1).collect()}
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(lm, "HOT", 20, raising=False)
    monkeypatch.setattr(F, "broadcast", lambda some: (sent.append(some.count()), broadcast(some))[1])
    found = lm.score(df, F.col("doc_id") < 300, sweeps=1, head=200, paired=10)
    assert sent and max(sent) <= 20
    assert {r.doc_id: round(r.score, 6) for r in found.collect()} == want


def test_reseating_samples_the_posterior():
    """The number of tables of a dish against its exact posterior, S(c, t) * mass ** t."""
    d, mass, c, n = 0.5, 3.0, 7, 100_000
    s = np.zeros((c + 1, c + 1))
    s[0, 0] = 1
    for i in range(1, c + 1):
        for t in range(1, i + 1):
            s[i, t] = s[i - 1, t - 1] + (i - 1 - d * t) * s[i - 1, t]
    want = s[c, 1:] * mass ** np.arange(1, c + 1)
    key, count, m = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.full(n, c), np.full(n, mass)
    tables = np.ones(n)
    for sweep in range(12):
        tables = lm.reseat(count, tables, m, d, lm._mix(key + np.uint64(sweep)))
    assert np.abs(np.bincount(tables.astype(int), minlength=c + 1)[1:] / n - want / want.sum()).max() < 0.01
    # beyond the table of exact values, against the recursion itself
    assert abs(lm.alone(np.array([600.0]), np.array([30.0]), d)[0] - lm.alone(np.array([512.0]), np.array([30.0 * (512 / 600) ** d]), d)[0] * (512 / 600) ** (1 - d)) < 1e-6


def test_language_model_scores_long_unseen_tokens(spark):
    rng = np.random.default_rng(4)
    rows = [(i, speech("en", 40, rng)) for i in range(40)] + [(100, "the"), (101, "the " + "qz7" * 1666 + "qz"), (102, "the " + "qz7" * 3333)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(df, F.col("doc_id") < 100, sweeps=2).where("doc_id >= 100").collect()}
    # each further byte of an unseen token costs at least as much as the commonest byte would
    assert got[101].score < got[100].score - 1000
    assert got[102].score < got[101].score - 1000
    assert got[101].perplexity > got[100].perplexity


def test_spelling_probabilities_sum_to_one():
    symbols, context, of = lm.spelled([b"the", b"then", b"of", b"", b"\xc3\xa9"] * 3)
    cells, to = np.unique(context * 257 + symbols, return_inverse=True)
    model = lm.fit_spelling(cells, np.bincount(to).astype(float))
    for c in set(context.tolist()):
        assert abs(np.exp(model.log_p(np.arange(257), np.full(257, c))).sum() - 1) < 1e-9


def test_seating_is_bounded_and_repeatable():
    count = np.array([0, 1, 2, 40, 1000, 10**6])
    key = np.arange(6, dtype=np.uint64)
    a, b = (lm.seat(count, np.full(6, 2.0), 0.5, key) for _ in range(2))
    assert (a == b).all() and a[0] == 0 and a[1] == 1 and (a <= count).all() and a[5] > a[4] > a[3]


def test_tokens_of_a_column_are_those_of_each_text(spark):
    """White space of six kinds, empty texts, bytes beyond ASCII, a slice of a column; tokens never join over texts."""
    rng = np.random.default_rng(9)
    for _ in range(100):
        some = [bytes(rng.choice(list(b" \t\n\x0b\x0c\r\x08\x0eAbc\xc3\xa9\x00z "), int(rng.integers(12))).tolist()) for _ in range(int(rng.integers(6)))]
        words, keys, ids, sizes = lm.lexed(pa.array([b"x y", *some], pa.binary()).slice(1))
        want = [[*lm.tokens(t), lm.END] for t in some]
        assert [words[i] for i in ids.tolist()] == [w for ws in want for w in ws]
        assert sizes.tolist() == [len(ws) for ws in want] and len(set(words)) == len(words) == len(keys)


def test_pairs_travel_as_blocks(spark):
    """Pairs that come more than once, counted as by plain Python; rows are some a bucket and task, not one a pair."""
    rng = np.random.default_rng(10)
    rows = [(i % 3 > 0, " ".join(f"w{int(x)}" for x in rng.integers(60, size=40))) for i in range(300)]
    df = spark.createDataFrame(rows, "_train boolean, _text string").repartition(3)
    trained, every = Counter(), Counter()
    for train, text in rows:
        ws = lm.hashed([lm.END, *lm.tokens(text.encode()), lm.END]).tolist()
        every.update(zip(ws, ws[1:], strict=False))
        trained.update(zip(ws, ws[1:], strict=False) if train else [])
    model = lm.fit(df, sweeps=1, head=30)
    key = {r._code: r._key for r in model.table.collect()}
    assert {(key[r._ctx], key[r._word]): r._all for r in model.several.collect()} == {p: n for p, n in every.items() if n > 1}
    assert {(r._ctx, r._word) for r in model.pairs.collect()} == set(trained)
    assert model.blocks.count() < len(every) / 10
