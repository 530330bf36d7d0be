"""The learned operators against plain versions: dense discriminants, dense ordinal scores, candidates by a regular expression."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from regioflux.llm import grammar, quality, secret_scan, textbytes, toxicity

SMALL = "/root/testdata/sf0.001"
LONG = "tok " * 200_000 + "end."
ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "x"), (904, LONG), (905, "again and again"), (905, "again and again")]


def given(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def docs_with_more_columns(spark):
    """The given documents and odd ones, beside columns with the names that the operators use themselves."""
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    docs = given(spark, "documents").select("doc_id", "text").union(odd)
    return docs.withColumns({"_key": F.lit(1), "_text": F.lit("x"), "toxic": F.lit(5), "feature": F.lit("f"), "quality": F.lit(9), "label": F.lit(0)})


def test_discriminant_equals_a_dense_one(spark):
    docs, labels = docs_with_more_columns(spark), given(spark, "labels")
    stats = quality.add_statistics(docs)
    model = quality.fit(stats, labels)
    rows = stats.select("doc_id", "stats").collect()
    classes = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    x = np.array([r.stats for r in rows])
    y = np.array([classes.get(r.doc_id, -1) for r in rows])
    own = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    share = np.array([(y == c).sum() for c in (0, 1)]) / (y >= 0).sum()
    pooled = share[0] * own[0] + share[1] * own[1]
    pooled = (1 - quality.DIAGONAL) * pooled + quality.DIAGONAL * np.diag(np.diag(pooled)) + quality.RIDGE * np.eye(x.shape[1])
    density = []
    for c in (0, 1):
        covariance = (1 - quality.POOLED) * own[c] + quality.POOLED * pooled
        away = x - x[y == c].mean(0)
        density.append(math.log(share[c]) - 0.5 * np.einsum("ij,ij->i", away, np.linalg.solve(covariance, away.T).T) - 0.5 * np.linalg.slogdet(covariance)[1])
    wanted = 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))
    scored = quality.score_texts(docs, model).select("doc_id", "score").collect()
    assert len(scored) == len(rows) == len(x)
    np.testing.assert_allclose(sorted(r.score for r in scored), sorted(wanted), atol=1e-5)
    by_row = {r.doc_id: w for r, w in zip(rows, wanted, strict=True)}
    assert max(abs(r.score - by_row[r.doc_id]) for r in scored) < 1e-5


def plain_features(text):
    """Words and their first 4 and 5 letters, the latter marked, of a text."""
    found = set()
    for word in brute.alnum(text):
        found.add((word, 0))
        found.update((word[:n], n) for n in (4, 5) if len(word) >= n)
    return found


def feature_print(feature):
    """The operator's number of one plain feature."""
    word, letters = feature
    part = next(iter(textbytes.slices(pa.array([word]))))
    values, _ = toxicity.features(part)
    return int(values[0] if not letters else values[1 if letters == 4 else -1])


def test_toxicity_equals_dense_scores(spark):
    docs, labels = docs_with_more_columns(spark), given(spark, "labels")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    found = toxicity.add_severity(docs, model).select("doc_id", "text", "severity", "toxic_score").collect()
    weights = dict(zip(model.known.tolist(), model.weights.tolist(), strict=True))
    assert len(weights) > 5 and list(model.thresholds) == sorted(model.thresholds)
    numbers: dict[tuple[str, int], int] = {}
    for r in found:
        if r.text is not None and r.text.isascii() and len(r.text) < 3000:
            features = plain_features(r.text)
            numbers.update((f, feature_print(f)) for f in features - numbers.keys())
            value = sum(weights.get(numbers[f], 0.0) for f in features)
            above = [1 / (1 + math.exp(-(value - t))) for t in model.thresholds]
            assert abs(r.severity - sum(above)) < 1e-9 and abs(r.toxic_score - above[0]) < 1e-9
    nothing = [1 / (1 + math.exp(t)) for t in model.thresholds]
    for r in found:
        if r.doc_id in (900, 901, 902):
            assert abs(r.severity - sum(nothing)) < 1e-9
    assert len(found) == docs.count()


def test_ordinal_fit_is_a_least_of_its_loss():
    rng = np.random.default_rng(3)
    dense = rng.random((400, 6)) < 0.3
    grade = np.clip((dense @ np.array([1.5, 1.0, 0.5, 0.0, 0.0, -1.0]) + rng.logistic(scale=0.5, size=400)).round(), 0, toxicity.GRADES).astype(int)
    weight = rng.choice([0.5, 1.5], 400)
    w, t = toxicity._fitted([np.flatnonzero(r) for r in dense], grade, weight, 6)

    def loss(w, t):
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        with np.errstate(over="ignore"):
            below = 1 / (1 + np.exp(-(edges[None, :] - (dense @ w)[:, None])))
        chance = below[np.arange(400), grade + 1] - below[np.arange(400), grade]
        return -(weight * np.log(np.maximum(chance, 1e-12))).mean() + toxicity.DECAY / 2 * (w**2).sum()

    least = loss(w, t)
    for i in range(6):
        for step in (-0.05, 0.05):
            assert loss(w + step * (np.arange(6) == i), t) > least - 1e-5
    for i in range(len(t)):
        for step in (-0.05, 0.05):
            assert loss(w, t + step * (np.arange(len(t)) == i)) > least - 1e-5


def test_format_spans_equal_a_plain_search(spark):
    rng = random.Random(4)
    key = lambda: "".join(rng.choice("ABCDEFGH") for _ in range(4)) + "-" + "".join(rng.choice("0123456789") for _ in range(14))
    texts = [f"é token={key()} and {key()} or {rng.choice(['word', 'Straße'])} x{'y' * 20}7 {rng.randrange(10**17)}a" for _ in range(120)]
    texts += [f"{'b' * 30_000}1 {key()}", f"{key()}\n{key()}", "", "plain"]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)] + [(500, None, "kept")], "doc_id long, text string, spans string").drop("spans")
    scanned = secret_scan.scan(docs)
    model = secret_scan.learn(scanned)
    found = {r.doc_id: r for r in secret_scan.add_spans(scanned, model).collect()}
    added = 0
    for i, text in [*enumerate(texts), (500, "")]:
        base = [(kind, start, int(name.split(":")[2])) for start, kind, name in brute.base_secrets(text)]
        wanted = list(base)
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text):
            if re.search("[A-Za-z]", m[0]) and re.search("[0-9]", m[0]) and all(m.end() <= s or m.start() >= e for _, s, e in base) and model.score(m[0]) >= model.least:
                wanted.append((3, m.start(), m.end()))
                added += 1
        assert [(x.kind, x.start, x.stop) for x in found[i].spans] == sorted(wanted, key=lambda x: (x[1], x[0]))
    assert added >= 100


def test_formats_are_learned_from_all_values(spark, monkeypatch):
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    values = sorted({*(f"sk-{some(9)}" for _ in range(2300)), *(some(12).upper() + "=" for _ in range(700)), "ab" * 2000, "sk-" + "7" * 3000})
    others = [f"w{some(20)}g{i}" for i in range(2500)]
    rows = [(i, f"token={v} {w}") for i, (v, w) in enumerate(zip(values, others * 2, strict=False))]
    docs = spark.createDataFrame(rows + rows[:900], "doc_id long, text string").repartition(5)
    scanned = secret_scan.scan(docs)
    model = secret_scan.learn(scanned)
    kinds = {k: sorted({x.value for r in scanned.select("secrets").collect() for x in r.secrets if x.kind == k}) for k in range(3)}
    assert kinds[0] == values and not kinds[1] and len(kinds[2]) == 2 and len(model.automata) == 2
    for automaton, texts in zip(model.automata, (kinds[0], kinds[2]), strict=True):
        moves = [{s: to for s, (to, _) in state.items()} for state in automaton.moves]
        counts: dict = {}
        for text in texts:
            grammar.walk(moves, text, counts)
        assert automaton == grammar.weighted(moves, counts) and sum(n for (_, s), n in counts.items() if not s) == len(texts)
    found = {x.value for r in scanned.select("candidates").collect() for x in r.candidates}
    letters = Counter("".join(map(grammar.shape, found)))
    total = sum(letters.values()) + len(found)
    assert model.background.moves == [{s: (0, math.log(n / total)) for s, n in sorted(letters.items())}] and model.background.ends == [math.log(len(found) / total)]
    own = sorted(model.score(x) for texts in kinds.values() for x in texts)
    assert model.least == max(own[int(secret_scan.LOWEST * len(own))], 1e-9)
    monkeypatch.setattr(secret_scan, "LOWEST", 0.5)
    assert secret_scan.learn(scanned).least == max(own[len(own) // 2], 1e-9)
    # Few states keep only the prefixes that most values share; the shares still come from all.
    monkeypatch.setattr(secret_scan, "STATES", 50)
    assert sum(math.exp(log) for _, log in secret_scan.learn(scanned).automata[0].moves[0].values()) > 0.5


def test_counted_prefixes_merge_as_the_prefix_tree_does():
    rng = random.Random(1)
    values = sorted({rng.choice(["ab", "sk_live_"]) + "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([8, 12]))) for _ in range(300)})
    found = secret_scan._prefixes(np.zeros(len(values), dtype=np.int64), values)
    nodes: dict = {}
    for prefix, symbol, n in zip(*(found[c].tolist() for c in ("prefix", "symbol", "n")), strict=True):
        nodes.setdefault(prefix, {})[chr(symbol) if symbol else ""] = n
    moves, plain, counts = grammar.structure(nodes, secret_scan._child), grammar.infer(values), {}
    assert len(moves) > 5 and moves == [{s: to for s, (to, _) in x.items()} for x in plain.moves]
    assert moves == grammar.structure({p: x for p, x in nodes.items() if sum(x.values()) > 1}, secret_scan._child)
    for value in values:
        grammar.walk(moves, value, counts)
    automaton = grammar.weighted(moves, counts)
    assert all(abs(automaton.score(x) - plain.score(x)) < 1e-12 for x in values)


def test_no_prefix_is_too_rare_for_the_merges(spark, monkeypatch):
    rng = random.Random(12)
    some = lambda n, of="0123456789abcdef": "".join(rng.choice(of) for _ in range(n))
    values = sorted({*(some(rng.choice([6, 9])) + "." for _ in range(2500)), *(f"QZ-{some(3, '012')}=" for _ in range(40)), "7" * 3000})
    hexes = sorted({some(30) for _ in range(50)})
    held = spark.createDataFrame([(0, v) for v in values] + [(2, v) for v in hexes], "kind long, value string").repartition(3)
    plain = {k: [{s: to for s, (to, _) in x.items()} for x in grammar.infer(v).moves] for k, v in ((0, values), (2, hexes))}
    assert len(plain[0]) > 5 and plain[0][0]["G"] > 0  # the 40 values have states of their own
    assert secret_scan._structures(held) == plain
    # A tree that the driver doesn't hold is merged by Spark, to the same states.
    monkeypatch.setattr(secret_scan, "STATES", 64)
    monkeypatch.setattr(secret_scan, "VISITS", 5000)
    assert secret_scan._structures(held) == plain
