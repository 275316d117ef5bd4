"""Odd inputs of every operator: repeated rows, null ids, ties, several vector lengths; wide blocks and wrapped notices."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("brindle.llm")

from brindle.llm import ann, attribution, common, licenses, lines, minhash, mixing, packing, quality, secrets, vectordup  # noqa: E402

T = "doc_id long, text string, source string"
LONG = "a line of more than twenty characters"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "s")[:3] for r in rows], T).repartition(3)


def test_lines_of_repeated_ids(spark):
    """A line goes from the rows that hold it, and from no other row of that id."""
    got = lines.deduplicate(docs(spark, [(1, "the first line, A, of some length"), (2, "the first line, A, of some length"), (2, "quite another thing, B, stands here")])).collect()
    assert sorted((x["doc"]["doc_id"], x["doc"]["text"]) for x in got) == [(1, "the first line, A, of some length"), (2, ""), (2, "quite another thing, B, stands here")]


def test_near_lines_of_repeated_ids(spark):
    rows = [(1, f"{LONG} x\n{LONG} of another kind"), (1, f"{LONG} y\n{LONG} of another kinds"), (2, f"{LONG} z"), (3, f"{LONG} of another kinde"), (None, f"{LONG} x"), (4, None)]
    got = {(x["doc"]["doc_id"], x["doc"]["text"]) for x in lines.deduplicate(docs(spark, rows)).collect()}
    assert got == {rows[0], rows[1], (2, ""), (3, ""), rows[4], rows[5]}


def test_shortest_line(spark):
    got = lines.deduplicate(docs(spark, [(1, "x" * 19 + "\n" + "y" * 20), (2, "x" * 19 + "\n" + "y" * 20)])).collect()
    assert {(x["doc"]["doc_id"], x["doc"]["text"]) for x in got} == {(1, "x" * 19 + "\n" + "y" * 20), (2, "x" * 19)}


def test_many_distances_at_once():
    r = random.Random(1)
    a = ["".join(r.choice("abé") for _ in range(r.choice([0, 1, 5, 21, 70, 300]))) for _ in range(3000)]
    b = ["".join(c for c in x if r.random() > 0.03) + r.choice(["", "a", "bb"]) for x in a]
    k = np.array([r.randrange(9) for _ in a])
    assert lines.within_many(a, b, k).tolist() == [lines.within(x, y, e) for x, y, e in zip(a, b, k.tolist(), strict=True)]


def test_jvm_and_python_hash_lines_alike(spark):
    texts = ["", "a", "é日本", "x" * 33, LONG, "1234567", "12345678901"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(lines.hashes(F.col("t"))[0]).collect()] == [lines.line_hash(t.encode()) for t in texts]


def test_groups_beyond_one_block(spark):
    """Rows unlike the pivot are compared with all others, block by block."""
    r = random.Random(2)
    links = {frozenset(r.sample(range(60), 2)) for _ in range(40)}
    members = common.stored(spark.createDataFrame([(k, i) for k in (7, 8) for i in range(60)], "key long, id long"), "t")

    def pairs(dealt):
        return dealt.where(~F.col("head")).select("id", "pivot").where(F.concat_ws("-", "pivot", "id").isin(*["-".join(map(str, sorted(x))) for x in links]))

    def rest(dealt):
        # within a task: rows of a pair of blocks meet
        a, b = dealt.alias("a"), dealt.alias("b")
        met = a.join(b, ["key", "bi", "bj"]).where("a.id < b.id and (bi = bj or a.blk <> b.blk)")
        return met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct().where(F.concat_ws("-", "a", "b").isin(*["-".join(map(str, sorted(x))) for x in links]))

    up = list(range(60))
    for x, y in (sorted(x) for x in links):
        while up[x] != x:
            x = up[x]
        while up[y] != y:
            y = up[y]
        up[max(x, y)] = min(x, y)

    def root(x):
        return x if up[x] == x else root(up[x])

    got = {x.node: x.component for x in common.star_components(members, "t", pairs, rest, rows=8).collect()}
    assert got == {i: root(i) for x in links for i in x}


def test_overlapping_groups_are_dealt_once(spark):
    """Large groups of one pivot with much the same rows cost what one of them does, whatever their number, and every two of their rows still meet."""
    rows = [(k, i) for k in range(10, 16) for i in range(100) if i != k] + [(20, i) for i in range(0, 100, 2)] + [(30 + k, i) for k in range(3) for i in (200, *range(201 + 40 * k, 241 + 40 * k))]
    stars = common.Stars(common.stored(spark.createDataFrame(rows, "key long, id long"), "t"), "t")
    near = common.stored(spark.createDataFrame([(1, 0), (2, 0)], "id long, pivot long"), "t")
    dealt = [tuple(x) for x in stars.rest(near, rows=8).select("key", "bi", "bj", "blk", "id").collect()]
    met = set()
    for task in {x[:3] for x in dealt}:
        some = [x[3:] for x in dealt if x[:3] == task]
        met |= {(a, b) for p, a in some for q, b in some if a < b and (task[1] == task[2] or p != q)}
    groups = {k: [i for key, i in rows if key == k] for k, _ in rows}
    assert {(a, b) for g in groups.values() for a in g for b in g if min(g) < a < b} - met <= {(1, 2)}
    # 97 far rows and 2 near ones in 13 blocks and one, and 40 rows in 5 blocks three times: those share no more than their pivot
    assert len(dealt) == 97 * 14 + 2 * 13 + 3 * 40 * 5


def test_hot_groups_are_joined_whole(spark):
    rows = [(1, i) for i in range(500)] + [(2, 1), (3, 1), (3, 2)]
    df = common.stored(spark.createDataFrame(rows, "k long, v long"), "t")
    got = common.with_groups(df, ["k"], len(rows), F.min("v").alias("m"), least=2).collect()
    assert sorted((x.k, x.v, x.n, x.m) for x in got) == [(1, i, 500, 0) for i in range(500)] + [(3, 1, 2, 1), (3, 2, 2, 1)]
    assert {(x.k, x.n) for x in common.blocked(df, ["k"], len(rows), 100).collect()} == {(1, 500), (2, 1), (3, 1)}


def test_signature_filter_keeps_links():
    """Of pairs at the threshold, hardly any falls below what the filter asks for."""
    a, b = minhash._functions()
    agree = []
    for k in range(300):
        x = minhash._mix(np.arange(3000 * k, 3000 * k + 1150, dtype=np.uint64))
        v, w = (minhash._mix(minhash.signature(s, a, b)) >> np.uint64(56) for s in (x[:1075], x[75:]))
        agree.append((v == w).sum())
    assert min(agree) >= minhash._enough(1000 / 1150 - minhash.SLACK)


def test_documents_with_null_ids_and_versions(spark):
    words = " ".join(f"w{i}" for i in range(60))
    got = {x.doc_id: x.component_id for x in minhash.links(docs(spark, [(5, words), (None, words), (3, words + " end"), (5, "something else that is short"), (9, "")])).collect()}
    assert set(got) == {3, 5, 9} and got[3] == 3 and got[9] == 9 and got[5] in (3, 5)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id string, vec string").repartition(3)


def test_vectors_of_several_lengths(spark):
    """Each length links and searches among itself, however rare it is."""
    three = [(i, [1.0, float(i), 0.0], 1, "", "") for i in range(40)]
    rows = three + [(100, [1.0, 2.0], 1, "", ""), (101, [2.0, 4.0], 1, "", ""), (102, [1.0, 2.0], 2, "", ""), (200, [1.0] * 5, 1, "", ""), (250, [1.0] * 5, 1, "", ""), (300, [3.0] * 7, 1, "", ""), (350, [1.0] * 7, 1, "", ""), (400, [1.0] * 9, 1, "", ""), (450, [2.0] * 9, 1, "", "")]
    got = {x.vec_id: x for x in vectordup.links(vectors(spark, rows)).collect()}
    assert len(got) == len(rows)
    for a, b in ((100, 101), (200, 250), (300, 350), (400, 450)):
        assert (got[a].n_links, got[b].n_links, got[b].component_id) == (1, 1, a)
    assert got[102].n_links == 0
    near = {(x.query_id, x["rank"]): (x.vec_id, round(x.score, 9)) for x in ann.search(vectors(spark, rows), F.col("id") % 50 == 0).collect()}
    assert near[100, 1] == (101, 1.0) and near[100, 2] == (102, 1.0) and (100, 3) not in near
    assert near[300, 1] == (350, 1.0) and near[450, 1] == (400, 1.0) and near[200, 1] == (250, 1.0) and near[0, 5]


def test_vectors_of_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0], 1, "", ""), (1, [0.0, 1.0], 1, "", ""), (2, [0.0, 2.0], 1, "", ""), (None, [0.0, 1.0], 1, "", "")]
    got = {x.vec_id: (x.n_links, x.component_id) for x in vectordup.links(vectors(spark, rows)).collect()}
    assert got == {1: (1, 1), 2: (1, 1)}
    near = ann.search(vectors(spark, rows), F.col("id") == 2).collect()
    assert [(x.query_id, x["rank"], x.vec_id, x.score) for x in near] == [(2, 1, 1, 1.0)]


def test_nearest_in_a_wide_block(spark):
    """Near-random vectors in one block of more than 10,000: recall against brute force."""
    r = np.random.RandomState(3)
    x = r.normal(size=(11000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    got: dict = {}
    for row in ann.search(df, F.col("id") % 50 == 0).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 11000, 50):
        s = y @ y[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5].tolist()) & got[q])
    assert hits / (5 * len(got)) >= 0.9


def test_packing_repeats(spark):
    rows = [(1, "same text"), (1, "same text"), (None, "no id"), (2, None)]
    got = packing.pack(docs(spark, rows)).collect()
    assert len(got) == 4 and sorted((x.doc_id is None, x.doc_id or 0) for x in got) == [(False, 1), (False, 1), (False, 2), (True, 0)]
    assert sorted((x.sequence_id, x.offset) for x in got)[0] == (0, 0) and sum(x.length for x in got) == sum(x.doc_tokens for x in got)


def test_attribution_repeats(spark):
    got = attribution.token_counts(docs(spark, [(1, "one\ntwo"), (1, "one\ntwo"), (None, "x")])).collect()
    assert sorted((x.doc_id or 0, x.section) for x in got) == [(0, 0), (1, 0), (1, 0), (1, 1), (1, 1)]


def test_mixing_repeats(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "d e", "x"), (2, "f " * 40, None), (3, None, "y")]
    got = mixing.allocate(spark.createDataFrame(rows, T)).collect()
    assert len(got) == 5 and len({x.taken for x in got if x.doc_id == 1}) == 1
    assert sum(x.target for x in {x.source_size: x for x in got}.values()) == pytest.approx(48)
    assert all(x.taken <= 3 * x.size for x in got)


def test_mixing_over_many_sources(spark, monkeypatch):
    """Beyond the bound on broadcast sources the join is dealt by key and salt, with the same rows."""
    r = random.Random(4)
    rows = [(i, "w " * r.randrange(1, 30), r.choice("abcdef")) for i in range(300)]
    df = spark.createDataFrame(rows, T)
    one = {x.doc_id: (x.taken, x.target) for x in mixing.allocate(df).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert {x.doc_id: (x.taken, x.target) for x in mixing.allocate(df).collect()} == one


def test_secret_repeats(spark):
    got = secrets.digest(secrets.scan(docs(spark, [(1, "token=abcdefgh1"), (1, "nothing"), (None, "token=abcdefgh1"), (None, "x")]))).collect()
    assert sorted((x.doc_id or 0, x.n_assign) for x in got) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_license_repeats_and_wrapped_notices(spark):
    grant = dict(licenses.TEMPLATES)["mit-grant"].split()
    wrapped = "\n".join(" *  " + " ".join(grant[i : i + 7]) for i in range(0, len(grant), 7))
    rows = [(1, wrapped), (2, "Licensed under CC BY-NC 4.0"), (3, "Licensed under CC BY 4.0"), (4, "\n".join(grant)), (5, "MIT License"), (5, "none"), (None, "Apache License")]
    got = {}
    for x in licenses.scan(docs(spark, rows)).collect():
        got.setdefault(x.doc_id, []).append((x.labels, x.specific))
    assert got[1] == [("mit-grant", "mit-grant")] and got[2] == [("cc-by-nc", "cc-by-nc")] and got[3] == [("creative-commons", "creative-commons")]
    assert got[4] == [("mit-grant", "mit-grant")]  # a word a line
    assert sorted(got[5]) == [("", ""), ("mit", "mit")] and got[None] == [("apache", "apache")]


def brute_blocks(text, templates):
    """(label, at, containment, specific) of each block that meets the threshold, by trying every word."""
    w, out = licenses.words_of(text), []

    def held(template, at):
        need = set(licenses.tokens(template))
        return len(need & set(w[at : at + licenses.width_of(template)])) / len(need)

    for label, t in templates:
        for at in (i for i, x in enumerate(w) if x in licenses.tokens(t)):
            c = held(t, at)
            if c < licenses.THRESHOLD - 1e-9:
                continue
            stop, covered = at + licenses.width_of(t), False
            for _, o in templates:
                if set(licenses.tokens(t)) < set(licenses.tokens(o)) and licenses.width_of(o) >= licenses.width_of(t):
                    covered |= any(held(o, k) >= max(c, licenses.THRESHOLD) - 1e-9 for k in range(max(0, stop - licenses.width_of(o)), at + 1))
            out.append((label, at, round(c, 9), not covered))
    return sorted(out)


@pytest.mark.parametrize("slice_", [1, 7, 1024])
def test_license_blocks_by_brute_force(spark, monkeypatch, slice_):
    """Blocks of a family of templates in texts of their words, shuffled, spread and cut; texts in slices of any size."""
    monkeypatch.setattr(licenses, "SLICE", slice_)
    draw = random.Random(3)
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    templates = (("general", base), ("variant", base + " lambda"), ("twice", base + " alpha beta alpha"), ("short", "zeta mu"))
    rows = []
    for i in range(60):
        w = base.split() + draw.choice([[], ["lambda"], ["alpha", "mu"]])
        if i % 3 == 0:
            draw.shuffle(w)
        for _ in range(draw.randrange(4)):
            draw.choice([lambda: w.insert(draw.randrange(len(w)), draw.choice(["x", "zeta", "mu"])), lambda: w.pop(draw.randrange(len(w)))])()
        rows.append((i, draw.choice([" ", "\n", "\n# "]).join(["x"] * draw.randrange(9) + w * draw.randrange(1, 4))))
    got = {}
    for x in licenses.matches(docs(spark, rows), templates).collect():
        got.setdefault(x.doc_id, []).append((x.label, x.at, round(x.containment, 9), x.specific))
    want = {i: brute_blocks(t, templates) for i, t in rows}
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in want.items() if x}
    assert any(not x[3] for b in want.values() for x in b) and any(x[2] < 1 for b in want.values() for x in b)


def test_license_wrapped_narrow_and_scattered_words(spark):
    """A notice of any number of lines is met; its words scattered through a line or a text are not."""
    texts = dict(licenses.TEMPLATES)
    bsd = texts["bsd-disclaimer"].split()
    narrow = "\n".join("# " + " ".join(bsd[i : i + 5]) for i in range(0, len(bsd), 5))
    far = " ".join(w + " z" * 2000 for w in texts["mit-notice"].split())
    rows = [(1, narrow), (2, "The MIT students released a driving license under the rain"), (3, far), (4, texts["mit-body"]), (5, "x " * 20000 + narrow)]
    got = {x.doc_id: x for x in licenses.scan(docs(spark, rows)).collect()}
    assert got[1].labels == got[5].labels == "bsd-disclaimer" and got[1].score == 1.0
    assert [(got[i].labels, got[i].score) for i in (2, 3)] == [("", 0.0)] * 2
    assert got[4].labels == "mit-body,mit-condition,mit-grant,mit-warranty" and got[4].specific == "mit-body"


def test_every_license_body_wrapped(spark):
    """At 70 columns with comment leaders, each notice is found."""
    rows = []
    for i, (_, text) in enumerate(licenses.TEMPLATES):
        out, line = [], "#"
        for w in text.split():
            if len(line) + len(w) > 70:
                out.append(line)
                line = "#"
            line += " " + w
        rows.append((i, "\n".join(["intro words", *out, line, "and more"])))
    got = {x.doc_id: x.labels.split(",") for x in licenses.scan(docs(spark, rows)).collect()}
    assert all(label in got[i] for i, (label, _) in enumerate(licenses.TEMPLATES))


def test_quality_repeats(spark):
    rows = [(i, f"Good words of text number {i}.") for i in range(200)] + [(7, "Good words of text number 7."), (None, "")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 3)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs(spark, rows), labels).collect()
    assert len(got) == len(rows) and len({x.score for x in got if x.doc_id == 7}) == 1
    assert [x.held_out for x in got if x.doc_id is None] == [False] and sum(x.held_out for x in got if x.doc_id is not None) == sum(zlib.crc32(str(d).encode()) % 3 == 1 for d, _ in rows if d is not None)


def plain_risk(w, b, p, u, prior):
    """The non-negative risk of a linear model, stated plainly."""
    loss = lambda g: np.log1p(np.exp(-g))
    gp, gu = p @ w + b, u @ w + b
    return prior * loss(gp).mean() + max(0.0, loss(-gu).mean() - prior * loss(-gp).mean())


def test_quality_minimises_the_risk():
    """The fitted model's risk is below that of no model and of the plain unlabelled-as-negative one, and its prior near the truth."""
    r = np.random.RandomState(5)
    good, bad = r.normal(1.5, 1, size=(3000, 3)), r.normal(-1.5, 1, size=(3000, 3))
    mixed = np.concatenate([good[1500:], bad[:500]])  # three quarters are positive
    share = quality.mixture_share(good[:1500], mixed)
    assert abs(share - 0.75) < 0.06
    model = quality.fit(good[:1500], mixed, share)

    def one_hot(x):
        at, width = model.binned(x), model.weights.shape[1]
        out = np.zeros((len(x), model.weights.size))
        out[np.arange(len(x))[:, None], at + np.arange(x.shape[1]) * width] = 1
        return out

    p, u = one_hot(good[:1500]), one_hot(mixed)
    own = plain_risk(model.weights.ravel(), model.bias, p, u, share)
    naive = quality._minimise(*quality._binned(good[:1500], mixed), 0.0, 300, lambda sp, su, spread: spread(quality._binned(good[:1500], mixed)[1], (sp - 1) / len(sp)) + spread(quality._binned(good[:1500], mixed)[2], su / len(su)))
    assert own < plain_risk(np.zeros(model.weights.size), 0.0, p, u, share) and own < plain_risk(naive.weights.ravel(), naive.bias, p, u, share)
    right = (model.score(good[:1500]) >= 0.5).mean(), (model.score(bad[500:]) < 0.5).mean()
    assert sum(right) / 2 > 0.9  # both kinds weigh alike; only 500 rows of the second were seen, unlabelled


def test_quality_gradient():
    """spread gives the gradient of the risk's positive part by finite differences, and its negative where the second part is below zero."""
    r = np.random.RandomState(6)
    x = r.normal(size=(200, 2))
    seen = []

    def slopes(sp, su, spread):
        seen.append(spread(p, (sp - 1) / len(p)))
        return np.zeros_like(seen[-1])

    model, p, u = quality._binned(x[:100], x[100:])
    quality._minimise(model, p, u, 0.3, 1, slopes)

    def loss(w):
        return np.log1p(np.exp(-(w[p].sum(axis=1) + w[-1]))).mean()

    w = np.zeros(len(seen[0]))
    w[-1] = 0.3
    for k in (int(p[0, 0]), int(p[3, 1]), len(w) - 1):
        step = np.zeros_like(w)
        step[k] = 1e-6
        assert seen[0][k] == pytest.approx((loss(w + step) - loss(w - step)) / 2e-6, abs=1e-6)


def test_pipeline_stages_on_planted_copies(spark):
    """Copies go, one of each group stays, nothing else is lost, and pieces hold the mix: against plain statements."""
    import corpus_pipeline

    r = random.Random(12)
    base = [" ".join(f"w{r.randrange(5000)}" for _ in range(120)) for _ in range(12)]
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(base)]
    rows += [(100 + i, t + " end", "a") for i, t in enumerate(base[:5])] + [(200, base[6], "b")]
    df = spark.createDataFrame(rows, T)
    kept = corpus_pipeline.drop_near_documents(spark, df, "")
    assert sorted(x.doc_id for x in kept.collect()) == list(range(12))
    mixed = common.stored(corpus_pipeline.mix_sources(spark, kept, ""), "t")
    taken = {x.doc_id: x.taken // x["size"] for x in mixing.allocate(kept).collect()}
    assert sorted(x.doc_id for x in mixed.collect()) == sorted(i for i, n in taken.items() for _ in range(n))
    pieces = corpus_pipeline.pack_tokens(spark, mixed, "").collect()
    assert sum(x.length for x in pieces) == sum(x.doc_tokens for x in pieces if x.start == 0)
    assert {re.sub("[0-9]", "", str(type(x.ids))) for x in pieces} <= {"<class 'bytearray'>", "<class 'bytes'>"}
