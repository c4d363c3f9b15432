"""Quality discriminant, conversation repair and spelling variants against brute force, with the edge cases of their docstrings."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import conversation_repair as repair
from tidewatch.llm import quality_discriminant as quality
from tidewatch.llm import queries as llm_queries
from tidewatch.llm import spelling

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3


# ---- spelling -------------------------------------------------------------------------------------------------------


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def variants_by_hand(counts, ratio=10):
    near = defaultdict(list)
    for a, b in itertools.combinations(counts, 2):
        if abs(len(a) - len(b)) < 2 and one_apart(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, n in counts.items():
        if near[w]:
            best = min(near[w], key=lambda v: (-counts[v], v))
            if counts[best] >= ratio * n:
                form[w] = best
    out = {}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None)
    return out


def spelt(rng, n, alphabet, lengths):
    """Words and words a few errors away from them, so that near pairs, ties and chains are common."""
    words = {"".join(rng.choice(alphabet) for _ in range(rng.choice(lengths))) for _ in range(n)}
    for w in sorted(words):
        for _ in range(3):
            k = rng.randrange(len(w))
            words.add(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(alphabet) + w[k:], w[:k] + rng.choice(alphabet) + w[k + 1 :]]))
    return {w: rng.choice([2, 2, 3, 25, 25, 300, 4000]) for w in sorted(words) if len(w) >= 7}


@pytest.mark.parametrize("group", [spelling.GROUP, 3])
def test_variants_against_all_pairs(spark, group):
    rng = random.Random(group)
    counts = spelt(rng, 70, "aé", [7, 8, 9]) | spelt(rng, 40, "abcdeÿ×", [10, 13, 16])
    df = spark.createDataFrame([*counts.items()], "word string, n long").repartition(5)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(df, group=group).collect()}
    want = variants_by_hand(counts)
    assert got == want
    assert sum(v[3] > 3 for v in want.values()) > 100 and sum(v[0] is not None and v[1] != v[0] for v in want.values()) > 3


def test_automaton_numbers_and_is_minimal():
    words = sorted(a + b for a in ("", "x", "yx", "yyx") for b in ("tion", "tions", "ted", "ting"))
    automaton = spelling.Automaton(words)
    for k, w in enumerate(words):
        assert automaton._rest(automaton.root, 0, w, 0) == k
    assert automaton._rest(automaton.root, 0, "zzz", 0) == -1
    rest = {tuple(sorted(w[len(p) :] for w in words if w.startswith(p))) for w in words for p in [w[:k] for k in range(len(w) + 1)]}
    assert len(automaton.nodes) == len(rest)  # as many states as there are different sets of endings
    for w in [*words, "xtio", "tingg", "yyxtedd", "xxtion"]:
        assert {words[k] for k in automaton.one_error(w)} == {v for v in words if one_apart(v, w)}


def words_by_hand(rows, every=31):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def test_words_of_texts(spark):
    rng = random.Random(3)
    pool = ["Étalonnage", "étalonnage", "wonderful", "Wonderful", "ABCDEFG", "short", "naïveté", "x7wordwise", "multi×plied", "Ğlyphically"]
    rows = [(rng.choice([None, 5, k]), " ".join(rng.choice(pool) for _ in range(rng.randrange(60)))) for k in range(80)]
    rows += [(900, None), (901, ""), (902, " \n "), (903, "Ab" * 5000), (903, "Ab" * 5000), (904, " ".join(pool * 3000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("w"), "n": F.lit(1)}).repartition(3)
    got = {r.word: r.n for r in spelling.count_words(df, typo_every=spelling.TYPO_EVERY).collect()}
    assert got == words_by_hand(rows)
    assert spelling.group_variants(spelling.count_words(df.limit(0))).count() == 0


def test_spelling_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    counts = words_by_hand(rows)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in llm_queries.op13_spelling_variants(spark, SF).collect()}
    assert {w: r[2] for w, r in got.items()} == counts
    by_shape = defaultdict(set)  # words that agree but for one deleted place
    for w in counts:
        for k in range(len(w)):
            by_shape[w[:k] + w[k + 1 :]].add(w)
        by_shape[w].add(w)
    for w in random.Random(1).sample(sorted(counts), 1500):
        near = {v for s in [w, *(w[:k] + w[k + 1 :] for k in range(len(w)))] for v in by_shape[s] if v != w and one_apart(v, w)}
        assert got[w][3] == len(near)
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        assert got[w][0] == (best if best and counts[best] >= 10 * counts[w] else None)


# ---- conversations --------------------------------------------------------------------------------------------------


def fault_list(rows):
    seen, out = set(), []
    for role, text in rows:
        shown = text.strip(SPACE)
        if not shown:
            out.append(BLANK)
        elif (role, text) in seen:
            out.append(DUPLICATE)
        else:
            out.append(TRUNCATED if shown[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """All edit sequences up to the cost of deleting everything: least (cost, audit) with its rows."""
    best = (4 * len(rows), "D" * len(rows), [])

    def extend(k, cost, audit, made):
        nonlocal best
        if cost > best[0] or not re.fullmatch("(s?(ua)*u?)?", "".join(r[:1] or " " for r, _ in made)):
            return
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or " " for r, _ in made)):
            best = min(best, (cost, audit, made))
        for role in ("user", "assistant"):
            extend(k, cost + 3, audit + "I", [*made, (role, "")])
        if k < len(rows):
            role, text = rows[k]
            extend(k + 1, cost + 4, audit + "D", made)
            if faults[k] not in (BLANK, DUPLICATE):
                more = 3 * (faults[k] == TRUNCATED)
                extend(k + 1, cost + more, audit + "K", [*made, (role, text)])
                for new in ("user", "assistant"):
                    if new != role:
                        extend(k + 1, cost + more + 3, audit + "R", [*made, (new, text)])

    extend(0, 0, "", [])
    return best


def repaired_by_hand(rows):
    """rows: (turn, role, text) of one conversation, nulls gone but in turn."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = [(r, t) for _, r, t in rows]
    faults = fault_list(pairs)
    cost, audit, made = cheapest(pairs, faults)
    initials = [r[:1] or " " for r, _ in pairs]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    text = "\n".join(f"{r}:{t}" for r, t in made)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(df):
    out = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}
    assert len(out) == df.count()
    return out


def conversations(rng, n, most=6):
    out = []
    for c in range(n):
        for _ in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "sys"])
            text = rng.choice(["Yes.", "No!", "cut", "", " \n", None, "Why? ", "long " * 3 + ".", "é…", "Fine."])
            out.append((c if c else None, rng.choice([None, 0, 1, 2, 3, 5, 9, -4]), role, text))
    return out + out[::17]


@pytest.mark.parametrize("stretch", [(repair.ROWS, repair.CHARS), (1, 1 << 20), (2, 9)])
def test_repair_against_all_edits(spark, stretch):
    rows = conversations(random.Random(7), 70)
    df = spark.createDataFrame(rows, TURNS).withColumns({"times": F.lit("x"), "audit": F.lit(1), "cost": F.lit("c"), "part": F.lit(0)}).repartition(3)
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn, " " if role is None else role, " " if text is None else text))
    assert found(repair.repair(df, *stretch)) == {c: repaired_by_hand(r) for c, r in own.items()}


def test_a_long_conversation_in_stretches_of_many_tasks(spark):
    """The same rows in one stretch and in many, over several tasks."""
    rng = random.Random(11)
    rows = [(c, k, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Well.", "so", f"{k}!", f"{k}", ""])) for c in (4, 9) for k in range(1500)]
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    whole = found(repair.repair(df.coalesce(1), 10**6, 1 << 30))
    assert found(repair.repair(df, 50)) == whole
    assert all(len(r[6]) >= 1500 and re.fullmatch("[DIKR]+", r[6]) for r in whole.values())


def damaged_by_hand(rows):
    out = defaultdict(list)
    text_of = lambda x: " " if x is None else str(x)
    for c, turn, role, text in rows:
        case = zlib.crc32(f"{text_of(c)}:{text_of(turn)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        out[c] += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    return out


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    own = damaged_by_hand(rows)
    want = {c: repaired_by_hand(own[c]) if own[c] else (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c in {r[0] for r in rows}}
    assert found(llm_queries.op12_conversation_repair(spark, SF)) == want


def test_damage_of_odd_rows(spark):
    rows = conversations(random.Random(2), 400, 4)
    own = damaged_by_hand(rows)
    assert any(not own[r[0]] for r in rows)  # a conversation that loses every row
    df = spark.createDataFrame(rows, TURNS)
    want = {c: repaired_by_hand(own[c]) if own[c] else (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c in {r[0] for r in rows}}
    assert found(repair.repair_damaged(df)) == want
    assert repair.repair_damaged(df.limit(0)).count() == 0


def test_very_long_turns(spark):
    rows = [(1, 0, "user", "a b " * 500_000 + "?"), (1, 1, "assistant", "x" * 2_000_000), (1, 1, "assistant", "x" * 2_000_000), (2, None, None, None)]
    df = spark.createDataFrame(rows, TURNS)
    got = found(repair.repair(df))
    assert got[1][1:7] == (0, 1, 1, 1, 7, "KKD") and got[2] == (0, 1, 0, 0, 0, 4, "D", hashlib.sha256().hexdigest())


# ---- quality --------------------------------------------------------------------------------------------------------


def test_features_of_odd_texts():
    for text in ("", " \n\t", "a", "É", "|||", "A" * 100_000, "one two\n" * 3000, "😀 x", "\x00 .!?"):
        x = quality.statistics(text.encode())
        assert len(x) == len(quality.FEATURES) and np.isfinite(x).all()


def gaussians(seed, n=600):
    rng = np.random.default_rng(seed)
    d = len(quality.FEATURES)
    a, b = rng.normal(size=(d, d)) * 0.3 + np.eye(d), rng.normal(size=(d, d)) * 0.3 + 2 * np.eye(d)
    return rng.normal(size=(n, d)) @ a, rng.normal(size=(n, d)) @ b + 1.5


def test_difference_is_that_of_normal_densities():
    zero, one = gaussians(1)
    d = zero.shape[1]
    model = quality.Discriminant(quality.Moments.of(zero), quality.Moments.of(one), 0.3, 0.05)
    scale, x = model.scale, np.vstack([zero[:20], one[:20]])
    covariances = [np.cov((c / scale).T, bias=True) for c in (zero, one)]
    pooled = sum(len(c) * s for c, s in zip((zero, one), covariances, strict=True)) / (len(zero) + len(one))
    want = []
    for c, s in zip((zero, one), covariances, strict=True):
        s = 0.7 * s + 0.3 * pooled
        s = 0.95 * s + 0.05 * np.trace(s) / d * np.eye(d)
        z = x / scale - (c / scale).mean(axis=0)
        want.append(-0.5 * (np.einsum("ij,ij->i", z @ np.linalg.inv(s), z) + np.linalg.slogdet(s)[1]))
    assert np.allclose(model.difference(x), want[1] - want[0])


def test_moments_over_tasks_add_up(spark):
    zero, one = gaussians(2, 90)
    rows = [(label, k % 3, x.tolist()) for label, c in ((0, zero), (1, one)) for k, x in enumerate(c)]
    found = quality.moments(spark.createDataFrame(rows, "label int, fold int, x array<double>").repartition(5))
    for label, c in ((0, zero), (1, one)):
        for f in range(3):
            m = quality.Moments.of(c[f::3])
            assert found[label, f].n == m.n and np.allclose(found[label, f].s, m.s) and np.allclose(found[label, f].p, m.p)


def test_quality_held_out(spark):
    sf = SF.replace("0.01", "0.1")
    got = {r.doc_id: r for r in llm_queries.op11_quality_discriminant(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    pairs = pd.DataFrame([(r.score, r.predicted, labels[i]) for i, r in got.items() if r.held_out and i in labels], columns=["score", "predicted", "label"])
    assert len(pairs) > 900 and (pairs.predicted == pairs.label).mean() > 0.99
    assert (pairs.score[pairs.label == 1] >= 0.7).mean() > 0.995 and (pairs.score[pairs.label == 0] < 0.7).mean() > 0.97


def labelled(seed=4, n=240):
    rng = random.Random(seed)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(80)) + "."
    junk = lambda: " ".join(rng.choice(["BUY!!", "###", "| item |", "$$$ now"]) for _ in range(60))
    docs = [(k, good() if k % 3 else junk(), "en", "s", 1) for k in range(n)]
    return docs, [(k, int(k % 3 > 0), 0) for k in range(n)]


def test_quality_edges(spark):
    docs, labels = labelled()
    docs += [(None, docs[1][1], None, None, None), (500, None, None, None, None), (501, "", "", "", 0), (502, " \n", "", "", 0), (503, "w " * 200_000, "", "", 0), docs[5], docs[5]]
    labels += [(1, None, 0), (None, 1, 1), (2, 1, 0), (2, 0, 0), (7, 5, 0)]
    df = spark.createDataFrame(docs, DOCS).withColumns({"label": F.lit("x"), "x": F.lit(1), "fold": F.lit(9), "score": F.lit("s"), "quality": F.lit(0)}).repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.score_documents(df, lab).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add(r.score)
    assert by_id[None] == by_id[1] and by_id[500] == by_id[501] == by_id[502] and len(by_id[5]) == 1
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert all((r.score >= 0.7) == (r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id < 240)
    assert quality.score_documents(df.limit(0), lab).count() == 0
    none = quality.score_documents(df, lab.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    ones = quality.score_documents(df, lab.where("quality = 1 AND doc_id <> 2")).collect()
    assert {r.score for r in ones} == {1.0}


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs, labels = labelled()
    df = spark.createDataFrame(docs, DOCS)
    flipped = [(k, 1 - q if zlib.crc32(str(k).encode()) % 4 == 2 else q, 0) for k, q, _ in labels]
    got = [sorted((r.doc_id, round(r.score, 6)) for r in quality.score_documents(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, flipped)]
    assert got[0] == got[1]
