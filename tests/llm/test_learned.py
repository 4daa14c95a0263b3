import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.common import SPACED, corpus, empty, odd, odd_rows, words
from tokenledger.llm import arrow_text as at
from tokenledger.llm import html_extract, quality_classifier, quality_rules, toxicity


def brute_counts(t):
    w = SPACED.findall(t or "")
    seen, hit, lines, dup = {}, set(), set(), 0
    for k in range(len(w) - 2):
        seen.setdefault(tuple(w[k:k + 3]), []).append(k)
    for at_ in seen.values():
        if len(at_) > 1:
            hit |= {k + j for k in at_ for j in range(3)}
    for line in (t or "").split("\n"):
        if SPACED.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(hit)


def test_counts_equal_brute_force():
    texts = [t for _, t in corpus(2, 80)] + [r[1] for r in odd_rows()]
    texts += ["", "\n\n \n", "a b c a b c", "a\na\n\r\n a\na", "é# é# é# é#", "x " * 500 + "\n" + "x " * 500]
    got = quality_rules.stats_of(at.texts_of(pa.array(texts)))
    for k, t in enumerate(texts):
        assert tuple(int(got[c][k]) for c in quality_rules.COUNTS) == brute_counts(t), repr((t or "")[:80])


def test_rules_are_learned_pruned_and_emitted(spark):
    rng = np.random.default_rng(3)
    n = 3000
    x = {c: rng.random(n) for c in ("n_words", *quality_rules.RATIOS)}
    bad = ((x["symbol_ratio"] > 0.7) & (x["mean_word"] <= 0.5)) | (x["bang_ratio"] > 0.9)
    rules = quality_rules.learn(x, bad, np.arange(n) % 3 == 0)
    found = np.zeros(n, bool)
    for r in rules:
        found |= quality_rules._covers(r, x)
    assert (found == bad).mean() > 0.97 and (found & ~bad).mean() < 0.01
    df = spark.createDataFrame([tuple(float(x[c][k]) for c in x) for k in range(200)], ", ".join(f"{c} double" for c in x)) \
        .select(F.struct(*x).alias("stats"))
    rows = [r[0] > 0 for r in df.select(quality_rules.as_column(rules)).collect()]
    assert rows == found[:200].tolist()
    assert quality_rules.learn(x, np.zeros(n, bool), np.arange(n) % 3 == 0) == []


def labelled(spark, junk, n=240):
    rng = random.Random(5)
    docs = []
    for i in range(n):
        w = words(rng, rng.randint(60, 120))
        docs.append((i, junk(rng, w) if i % 4 == 0 else " ".join(w)))
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(n)] + [(3, 0, 1), (7, None, None)],
                                   "doc_id long, quality int, toxic int")
    return rows, labels, {i for i in range(n) if i % 4 == 0}


def test_quality_rules_reject_junk_only(spark):
    docs, labels, junk = labelled(spark, lambda rng, w: " ".join(x + rng.choice(["###", "***"]) for x in w))
    got = quality_rules.judged(docs, labels).collect()
    assert {r.doc_id for r in got if r.stats_rule > 0 and not r.stats_base_failed} == junk
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd_docs = odd(spark).drop("stats")
    got = quality_rules.judged(odd_docs, none)
    assert got.count() == len(odd_rows()) and got.where("stats_rule > 0").count() == 0
    assert quality_rules.judged(empty(spark).drop("stats"), labels).count() == 0


def test_classifier_separates_held_out_texts(spark):
    docs, labels, junk = labelled(spark, lambda rng, w: " ".join(x.upper() + "!!" for x in w))
    known = quality_classifier.learnable(labels, "quality", 3, 1)
    assert 3 not in {r.doc_id for r in known.collect()}        # contradicting labels are not learned from
    model = quality_classifier.train(docs, known)
    scores = quality_classifier.scored(docs, model).withColumn("held", quality_classifier.held_out(3, 1)).collect()
    held = [r for r in scores if r.held]
    assert held and all((r.score >= 0.5) == (r.doc_id not in junk) for r in held)
    assert quality_classifier.scored(odd(spark), model).count() == len(odd_rows())
    none = known.where("false")
    assert {r.score for r in quality_classifier.scored(docs, quality_classifier.train(docs, none)).collect()} == {0.5}
    assert quality_classifier.scored(empty(spark), model).count() == 0


def test_ftrl_scores_are_sparse_dot_products():
    rng = np.random.default_rng(0)
    w = rng.normal(size=quality_classifier.DIM).astype(np.float32)
    texts = at.texts_of(pa.array(["One two two. THREE", "", "a"]))
    total, grams = quality_classifier.features_of(texts)
    for k in range(3):
        dot = sum(w[i[r == k]].sum() for r, i in grams)
        want = 0.5 + quality_classifier.SCALE * (dot / total[k] if total[k] else 0)
        assert abs(quality_classifier.margins(texts, w, 0.5)[k] - want) < 1e-4


def phi(window):
    """Features of a window by the kernel's definition: (subsequence, weight)."""
    out, split = {}, window.split(" ")
    for word in split:
        s, own = "\x02" + word + "\x03", {}
        for i in range(len(s)):
            for a, b, c in toxicity._STEPS:
                if i + c < len(s):
                    u = s[i] + s[i + a] + s[i + b] + s[i + c]
                    own[u] = own.get(u, 0) + toxicity.DECAY ** (c - 3)
        scale = toxicity.scale(pa.array([word], pa.large_string()))[0]
        for u, v in own.items():
            out[u] = out.get(u, 0) + v * scale
    for k, word in enumerate(split):
        out[word,] = out.get((word,), 0) + 1
        for j in range(k + 1, len(split)):
            pair = word, split[j]
            out[pair] = out.get(pair, 0) + toxicity.DECAY ** (j - k - 1)
    return out


def test_kernel_features_equal_its_definition():
    """The explicit features give the kernel by its sum over subsequences."""
    pairs = [("idiot", "i.d.i.o.t"), ("idiot", "idiots"), ("idiot", "table"), ("aa", "aaaa"), ("moron", "moron"),
             ("you are trash", "you were trash"), ("a b a", "b a"), ("one  two", "two one"), ("", "x")]
    for a, b in pairs:
        y = phi(b)
        want = sum(v * y.get(u, 0) for u, v in phi(a).items())
        assert abs(toxicity._kernel([a], [b])[0, 0] - want) < 1e-6
    k = lambda b: toxicity._kernel(["idiot"], [b])[0, 0]
    assert k("idiot") > k("idi-ot") > k("table")


def test_machine_is_the_optimum_and_collapses_to_features():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(300, 7)), np.where(rng.random(300) < 0.2, 1.0, -1.0)
    x[y > 0, 0] += 1
    cost = np.where(y > 0, 0.5, 0.1)
    loss = lambda w: w @ w / 2 + cost @ np.maximum(0, 1 - y * (x @ w)) ** 2
    w = toxicity.solve(x, y, cost)
    for step in np.vstack([np.eye(7), -np.eye(7), rng.normal(size=(20, 7))]):
        assert loss(w) <= loss(w + 1e-3 * step)
    # plain descent comes to the same weights
    plain = np.zeros(7)
    for _ in range(20_000):
        plain -= 1e-3 * (plain - 2 * x.T @ (cost * y * np.maximum(0, 1 - y * (x @ plain))))
    assert np.abs(plain - w).max() < 1e-4
    # margins over features equal margins through the landmarks
    lines = ["you are rotten", "are you well", "rotten apples fell", "you were here", "well are rotten"]
    marks = ["rotten", "you are", "apples fell"]
    m = toxicity.machine(lines[:1] + lines[2:3], lines[1:2] + lines[3:], marks)
    base, cross = toxicity._kernel(marks, marks), toxicity._kernel(lines, marks)
    u = toxicity.units(at.texts_of(pa.array(lines)))
    got = toxicity.window_margins(u, m)[u.starts]
    by_landmark = np.linalg.lstsq(np.hstack([cross, np.ones((5, 1))]), got, rcond=None)
    assert np.abs(np.hstack([cross, np.ones((5, 1))]) @ by_landmark[0] - got).max() < 1e-4 and len(base) == 3


def test_margins_equal_a_plain_walk_over_windows():
    rng = random.Random(8)
    vocabulary = ["rot", "you", "are", "r.o.t", "fine", "and", "***", "Zeug", "été"]
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", "!", ",\n"]) for _ in range(rng.randint(0, 14)))
             for _ in range(80)] + [None, "", " ", "r o t you", "one"]
    m = toxicity.machine(["you are rot", "are rot and"], ["you are fine", "and you and"], ["rot", "you are", "fine and été"])
    alone = dict(zip(m.vocabulary.to_pylist(), m.alone))
    pairs = dict(zip(m.keys.tolist(), m.values))

    def margin(window):
        f = m.intercept + toxicity.evidence(pa.array(window, pa.large_string()), m.weights).sum()
        for term, weight in toxicity._terms(window):
            if len(term) == 1:
                f += alone.get(term[0], 0)
            else:
                key = toxicity.pair_keys(*(at.hash_strings([w]) for w in term))[0]
                f += weight * pairs.get(int(key), 0)
        return f

    got = toxicity.strongest(at.texts_of(pa.array(texts)), m)
    for text, (first, second) in zip(texts, got):
        sentences, tokens = [[]], (text or "").split()
        singles = [len(t) == 1 for t in tokens]
        for k, t in enumerate(tokens):
            sentences[-1].append(t.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
            if singles[k] and not (k + 1 < len(tokens) and singles[k + 1]) and k >= 2 and singles[k - 1] and singles[k - 2]:
                sentences[-1].append("".join(tokens[k - 2:k + 1]).lower())
            if t[-1] in ".!?":
                sentences.append([])
        windows, place = [], 0
        for s in sentences:
            windows += [(place + k, margin(s[k:k + 3])) for k in range(max(1, len(s) - 2)) if s]
            place += len(s)
        want = [toxicity.NONE, toxicity.NONE]
        if windows:
            best = max(windows, key=lambda v: (round(v[1], 9), -v[0]))
            apart = [v for v in windows if abs(v[0] - best[0]) >= 3]
            want = [best[1], max((f for _, f in apart), default=toxicity.NONE)]
        assert np.abs(np.maximum(want, toxicity.NONE) - [first, second]).max() < 1e-5, text


def test_toxicity_learns_insults_of_ordinary_words(spark):
    """Four phrases whose words stand, apart, in clean texts too."""
    phrases = ["lomi tensur vapel", "dorni eshun tragol", "bifen ousar quizet", "omka lopel tenni"]
    rng, rows = random.Random(3), []
    for i in range(600):
        w = words(rng, rng.randint(40, 90))
        if i % 5 == 0:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(phrases))
        else:
            for word in " ".join(phrases).split():
                w.insert(rng.randrange(len(w)), word)
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.train(docs, quality_classifier.learnable(labels, "toxic", 5, 0))
    held = toxicity.scored(docs, model).where(quality_classifier.held_out(5, 0)).collect()
    toxic = [r.score >= 0.5 for r in held if r.doc_id % 5 == 0]
    clean = [r.score >= 0.5 for r in held if r.doc_id % 5]
    assert len(toxic) > 10 and np.mean(toxic) > 0.8 and np.mean(clean) < 0.05


@pytest.mark.parametrize("most", [1, 7, 400, 2999, 5000])
def test_bounded_samples_are_the_smallest_hashes(spark, most):
    rows = spark.range(3000).selectExpr("id % 2900 as doc_id", "id").repartition(5)
    hashed = rows.withColumn("h", F.xxhash64("doc_id"))
    want = [r.h for r in hashed.orderBy("h").limit(most).collect()]
    kept = quality_classifier.smallest(hashed, most)
    assert [r.h for r in quality_classifier.sample(rows, most).collect()] == want
    assert min(most, 3000) <= kept.count() <= 2 * most + 2
    # one hash for all rows cannot be cut by prefixes; nothing is lost
    assert quality_classifier.smallest(rows.withColumn("h", F.lit(-5).cast("long")), most).count() == 3000
    assert quality_classifier.smallest(hashed.where("false"), most).count() == 0


def test_toxicity_finds_held_out_and_disguised_insults(spark):
    insults = ["blorfgut", "snazzwick", "grimplet"]

    def curse(rng, w):
        for _ in range(3):
            w.insert(rng.randrange(len(w)), rng.choice(insults))
        return " ".join(w)

    docs, labels, bad = labelled(spark, curse, 400)
    known = quality_classifier.learnable(labels, "toxic", 5, 0)
    model = toxicity.train(docs, known)
    scores = toxicity.scored(docs, model).withColumn("held", quality_classifier.held_out(5, 0)).collect()
    held = [r for r in scores if r.held]
    assert held and np.mean([(r.score >= 0.5) == (r.doc_id in bad) for r in held]) > 0.95
    rng = random.Random(1)
    clean = " ".join(words(rng, 40))
    new = spark.createDataFrame([(1, clean), (2, clean + " Blorf-gut, you blorfgut!"), (3, clean + " b l o r f g u t, s.nazz.wick"),
                                 (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.scored(new, model).collect()}
    assert got[2] > 0.5 > got[1] and got[3] > got[1] and got[4] < 0.5 and got[5] < 0.5
    assert toxicity.scored(odd(spark), model).count() == len(odd_rows())
    one_kind = known.where("y = 0")
    assert {r.score for r in toxicity.scored(new, toxicity.train(docs, one_kind)).collect()} == {0.0}


def test_main_text_of_held_out_pages(spark):
    field = html_extract.train(html_extract.labelled_pages())
    wrong = total = 0
    for page, content in html_extract.labelled_pages(120, seed=77):
        blocks = html_extract.blocks_of(page)
        for b, s in zip(blocks, field.decode(html_extract.features(blocks))):
            total += 1
            wrong += (b.text in content and "head" not in b.tags) != bool(s)
    assert wrong / total < 0.03
    text = html_extract.main_text(
        "<html><head><title>T</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class='ad'>Buy now.</div>"
        "<article><h1>A &amp; B</h1><p>One  two,\n<b>three</b> four.<br>Five six&quot;.<p>Seven &lt;eight&gt; nine &am"
        "<script>var t='</p>';</script></article><div id=comments><div class=comment><p>Nice one.</p></div></div>"
        "<footer>&copy; x</footer>", field)
    assert text == 'A & B\n\nOne two, three four. Five six".\n\nSeven <eight> nine &am'
    pages = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, None, "<p"), (3, None, "<p")], "page_id long, url string, html string")
    assert [r.text for r in html_extract.extract(pages).collect()] == ["", "", "", ""]
    assert html_extract.extract(pages.where("false")).count() == 0


@pytest.mark.parametrize("page,want", [
    ('<p><svg class="i"/>Read this.</p><p>More.</p>', ["Read this.", "More."]),
    ('<p><svg class="i">Read this.</p><p>More.</p>', ["Read this.", "More."]),
    ('<p><svg><title>Icon</title><style/><path d="M0"/></svg>Read this.</p><p>More.</p><svg></svg>', ["Read this.", "More."]),
    ("<p>One <noscript>two</noscript> <math><mi>x</mi></math> <object>three</object>.</p>", ["One two x three."]),
    ("<div><object data=a><p>Inside.</p></div><template><p>Later.</p>", ["Inside.", "Later."]),
    ("<p title=it's>Hello. I don't know <b>x</b></p>", ["Hello. I don't know x"]),
    ("""<p title="a > b" class = 'c > d'>Whole.</p><p "'>Stray.</p>""", ["Whole.", "Stray."]),
    ("<p><svg>One<br/>two<p/>three", ["One two", "three"]),
    ("<p>Before.<script>var a = '<p>no</p>'", ["Before."]),
])
def test_rest_of_the_page_is_kept(page, want):
    assert [b.text for b in html_extract.blocks_of(page)] == want


def test_viterbi_is_the_best_path():
    rng = random.Random(2)
    field = html_extract.Field({f"f{k}": rng.gauss(0, 1) for k in range(6)}, np.array([[0.4, -0.6], [-0.3, 0.7]]))
    import itertools
    for _ in range(50):
        rows = [rng.sample(sorted(field.emit), 2) for _ in range(rng.randint(1, 7))]
        score = lambda p: sum(s * sum(field.emit[f] for f in r) for s, r in zip(p, rows)) \
            + sum(field.step[a, b] for a, b in zip(p, p[1:]))
        best = max(itertools.product((0, 1), repeat=len(rows)), key=score)
        assert abs(score(field.decode(rows)) - score(best)) < 1e-9
