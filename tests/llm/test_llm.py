"""Small cases of each training-data operator against brute force, exact round trips or rules."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenquarry.llm import cutoff, eval_leaks, format_copies, near_groups, packing, reply_defects, split_overlap, shared, splitting, subjects
from lumenquarry.llm.shared import cut, expanded

WORD = re.compile(r"[^\W_]+")
def clash(*names):
    """Columns of the operators' own inner names, with other content."""
    return {n: F.lit("clash") for n in names}


def bare(s):
    return "".join(WORD.findall((s or "").lower()))


# 1 same or near-same records across splits

SAMPLE = "sample_id string, question string, answer string"


def overlap_truth(rows):
    seen = {i: (bare(a), set(WORD.findall(q.lower()))) for i, q, a in rows if i and q is not None and a is not None}
    out = set()
    for t, (ta, tw) in seen.items():
        for e, (ea, ew) in seen.items():
            if "_train_" in t and re.search("_(val|test)_", e) and ta and ta == ea and tw and ew:
                if len(tw & ew) * 10 >= 7 * len(tw | ew):
                    out.add((t, e))
    return out


def test_overlap_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(260):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rng.shuffle(words)
        else:
            words = [vocabulary[min(59, int(rng.expovariate(0.1)))] for _ in range(rng.randint(1, 18))]
        rows.append((f"x_{rng.choice(['train', 'train', 'val', 'test'])}_{i}", " ".join(words), rng.choice(["Yes", "yes!", "no", "left lung", ""])))
    rows += [("x_train_900", "a b", "hot"), ("x_test_900", "B, a?", "HOT."), ("x_train_901", None, "hot"), ("x_val_901", "a b", None), (None, "a b", "hot"), ("x_val_902", "?!", "hot"), ("x_train_900", "a b", "hot")]
    df = spark.createDataFrame(rows, SAMPLE).withColumns(clash("key", "class", "symbols"))
    records = split_overlap.split_records(df)
    got = split_overlap.pairs(records).collect()
    assert len(got) == len({(r.train_id, r.eval_id) for r in got})
    assert {(r.train_id, r.eval_id) for r in got} == overlap_truth(rows)
    assert all(r.n_common * 10 >= 7 * r.n_either and 1 <= r.longest_run <= r.n_common for r in got)
    rep = split_overlap.report(records).collect()
    assert sum(r.n_pairs for r in rep) == len(got)


def test_overlap_of_hot_keys_in_blocks(spark, monkeypatch):
    """Keys over the limit are spread over blocks; no pair is lost or told twice."""
    monkeypatch.setattr(split_overlap, "KEY_ENTRIES", 5)
    monkeypatch.setattr(split_overlap, "SHARD_ENTRIES", 20)
    rows = [(f"x_{'train' if i % 2 else 'val'}_{i}", f"same rare words here {'abcdefgh'[i % 8]}{i // 16}", "yes") for i in range(64)]
    got = [(r.train_id, r.eval_id) for r in split_overlap.pairs(split_overlap.split_records(spark.createDataFrame(rows, SAMPLE))).collect()]
    assert len(got) == len(set(got)) and set(got) == overlap_truth(rows)


def test_overlap_of_very_long_questions(spark):
    words = [f"w{i}" for i in range(8000)]
    rows = [("x_train_1", " ".join(words), "yes"), ("x_val_1", " ".join(words[300:] + ["a"] * 9), "yes"), ("x_test_2", " ".join(words[4000:]), "yes"), ("x_train_2", "w1 w2", "yes")]
    got = {(r.train_id, r.eval_id): r for r in split_overlap.pairs(split_overlap.split_records(spark.createDataFrame(rows, SAMPLE))).collect()}
    assert set(got) == {("x_train_1", "x_val_1")} and got["x_train_1", "x_val_1"].n_common == 7700


def test_overlap_of_nothing(spark):
    assert split_overlap.pairs(split_overlap.split_records(spark.createDataFrame([], SAMPLE))).count() == 0


def test_backward_index():
    rng = np.random.default_rng(1)
    words = [rng.integers(1, 5, rng.integers(1, 30)).astype(np.uint64) for _ in range(200)]
    marks = [rng.integers(0, 3, len(w)) for w in words]
    index = split_overlap.BackwardIndex(words, marks)
    for pattern in ([(1, 0)], [(2, 1), (3, 0)], [(4, 2), (4, 2), (1, 1)], [(9, 0)]):
        lo, hi = np.array([0]), np.array([index.n])
        for s in index.signs(np.array([w for w, _ in pattern], np.uint64), np.array([m for _, m in pattern])):
            lo, hi = index.extend(np.array([s]), lo, hi) if s >= 0 else (lo * 0, lo * 0)
        found = sorted(zip(*(v.tolist() for v in index.locate(np.arange(lo[0], hi[0])))))
        both = [list(zip(w.tolist(), m.tolist())) for w, m in zip(words, marks)]
        assert found == sorted((k, i + len(pattern) - 1) for k, e in enumerate(both) for i in range(len(e) - len(pattern) + 1) if e[i : i + len(pattern)] == pattern)
    here = np.arange(len(words))  # backward steps from the end of an entry spell it out
    for d in range(30):
        sign, here = index.step(here)
        for k in np.flatnonzero(index.sizes > d):
            assert index.alphabet[index.word_of[sign[k]]] == words[k][d]


def test_overlap_comes_from_the_index(spark, monkeypatch):
    """Pairs are counted by what the index spells out: without its steps there are none."""
    rows = [(f"x_{'train' if i % 2 else 'val'}_{i}", "one two three four five", "yes") for i in range(6)]
    df = split_overlap.split_records(spark.createDataFrame(rows, SAMPLE))
    assert split_overlap.pairs(df).count() == 9
    x = [np.array([1, 2, 3, 4, 5], np.uint64)]
    index = split_overlap.BackwardIndex(x, [np.array([1, 0, 0, 0, 0])])
    words = (np.arange(5), np.arange(5), 6)
    follow = lambda: split_overlap._follow(np.array([b"x"]), np.array([5]), np.array([0]), np.array([0]), *index.extend(index.signs(x[0][:1], np.array([1])), np.array([0]), np.array([index.n])), index, np.array([b"y"]), words)
    assert follow().values.tolist() == [[b"x", b"y", 5, 5, 1, 5]]
    monkeypatch.setattr(index, "locate", lambda suffix: (np.array([0]), np.array([0])))
    assert len(follow())
    monkeypatch.setattr(index, "step", lambda suffix: (np.zeros(len(suffix), np.int64), suffix))
    assert not len(follow())


def test_overlap_spans(spark):
    rows = [("x_train_1", "a b c d e f g h i j k l", "yes"), ("x_val_1", "a b c d e X g h i j k l", "yes")]
    got = split_overlap.pairs(split_overlap.split_records(spark.createDataFrame(rows, SAMPLE))).first()
    assert (got.n_common, got.n_either) == (11, 13) and 1 <= got.n_spans <= 3 and got.longest_run * got.n_spans >= 11


def test_overlap_of_a_key_that_is_hot_in_training(spark, monkeypatch):
    """Few evaluation records and very many training records with their key: several tasks share a shard."""
    monkeypatch.setattr(split_overlap, "SHARD_RECORDS", 10)
    rows = [("x_val_0", "rare word common one", "yes"), ("x_test_0", "rare word common two", "yes")] + [(f"x_train_{i}", f"rare word common n{i % 70}", "yes") for i in range(140)]
    rows += [(f"x_train_{i}", "rare word common one", "yes") for i in range(200, 230)]
    records = split_overlap.split_records(spark.createDataFrame(rows, SAMPLE))
    got = [(r.train_id, r.eval_id) for r in split_overlap.pairs(records).collect()]
    assert len(got) == len(set(got)) and set(got) == overlap_truth(rows)
    assert {r.split: (r.n_pairs, r.n_same) for r in split_overlap.report(records).collect()} == {s: (sum(f"_{s}_" in e for _, e in got), n) for s, n in (("val", 1), ("test", 0))}


# 2 splitting

DOCS = "doc_id long, text string, entity_name string"


@pytest.mark.parametrize("sep", [" ", "\n\n", ". ", "　", "  ", "; "])
def test_pieces_round_trip(spark, sep):
    text = sep.join(f"w{i}" for i in range(1000))
    df = spark.createDataFrame([(1, "  " + text, " E ")], DOCS)
    parts = splitting.pieces(df).first().pieces
    assert "".join(p.new_text for p in parts) == text
    for before, p in zip(parts, parts[1:]):
        assert p.overlap_text.split() == "".join(q.new_text for q in parts[: parts.index(p)]).split()[-40:]
    rows = splitting.exploded(df).orderBy("chunk_index").collect()
    assert all(r.n_words <= 300 for r in rows) and [r.chunk_index for r in rows] == list(range(len(rows))) and rows[0].entity_name == "E"


def test_pieces_end_at_sentences(spark):
    text = " ".join("This is sentence number %d of the text." % i for i in range(80))
    for p in splitting.pieces(spark.createDataFrame([(1, text, None)], DOCS)).first().pieces:
        assert p.new_text.rstrip().endswith(".")


def test_pieces_edges(spark):
    long_run = "x" * 10_000
    df = spark.createDataFrame([(1, None, None), (2, "", None), (3, " \n ", None), (4, "a " * 300, None), (5, "a " * 301, None), (6, long_run, None), (7, "é " * 301, None), (8, f"{long_run} " * 301, None)], DOCS).withColumns(clash("pieces"))
    n = {r.doc_id: len(r.pieces) for r in splitting.pieces(df).collect()}
    assert (n[1], n[2], n[3], n[4], n[6]) == (0, 0, 0, 1, 1) and n[5] == 2 and n[7] == 2 and n[8] > 2
    assert splitting.pieces(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitting.pieces(df, 10, 10)


# 3 defects


def test_defects(spark):
    good = []
    for i, (f, p) in enumerate((f, p) for f in ("cyst", "mass", "tear", "polyp", "ulcer") for p in ("left lung", "right knee", "skull base", "heel pad")):
        good += [(f"g{i}a", "Where is it?", f"The {f} lies in the {p}, about {i} mm from the {p}."), (f"g{i}b", "What is it?", f"{f} of the {p}"), (f"g{i}c", "Which?", f), (f"g{i}d", "Where?", p)]
    good += [(f"y{i}", "Is it?", "yes") for i in range(30)]
    bad = {
        "e1": ("Is it?", None, "empty"), "e2": ("Is it?", " -- ", "empty"), "e3": ("Is it?", "N/A", "empty"), "n1": ("Is it?", "none", None),
        "c1": ("Which structure does the Rabex catheter 405 cross on ct 99 before the stent?", "q: which structure does the rabex catheter 405 cross on ct 99 before the stent", "question_copy"),
        "c2": ("Which structure does the Rabex catheter 405 cross on ct 99 before the stent?", "The Rabex catheter 405 crosses the left lung on ct 99 and then bends into a wide open space below the second rib", None),
        "r1": ("Is it?", "I'm sorry, but I can't give a reading.", "refusal"), "r2": ("是吗？", "抱歉，无法回答", "refusal"), "r3": ("Is it?", "Je ne peux pas répondre.", "refusal"),
        "r4": ("Is it?", "The patient was unable to hold still.", None),
        "l1": ("Is it?", "Kein Befund am Handgelenk", "other_language"), "l2": ("Is it?", "可见右肺", "other_language"), "l3": ("右肺有什么？", "右侧", None), "l4": ("右肺有什么？", "both the lungs show it", "other_language"),
        "t1": ("Where is it?", "The cyst lies in the left lung, about 4 mm from the", "truncated"), "t2": ("Where is it?", "The tear lies in the skull base, about 3 mm fro", "truncated"), "t3": ("Where is it?", "The polyp lies in the heel pad", "truncated"),
    }
    rows = [*good, *((k, q, a) for k, (q, a, _) in bad.items()), ("e1", "Is it?", None)]
    samples = spark.createDataFrame(rows, SAMPLE).withColumns(clash("reply", "defect"))
    results = spark.createDataFrame([(7, "Is it?", "null"), (8, None, "yes"), (None, "q", "")], "result_id long, question string, prediction string")
    got = {(r.record_kind, r.record_key): r.defect for r in reply_defects.defects(reply_defects.replies(samples, results)).collect()}
    assert got == {("sample", k): d for k, (_, _, d) in bad.items() if d} | {("result", "7"): "empty"}


@pytest.mark.parametrize("turn", [1, -1])
def test_short_replies_to_questions_of_several_languages(spark, turn):
    asked = {
        "en": "Which of the findings in the left wrist is seen on the second image of this series, and is it new or was it there before?",
        "de": "Welcher Befund ist auf dem zweiten Bild der Serie am linken Handgelenk zu sehen, und ist er neu oder war er schon da?",
    }
    rows = [(k, q, "Kein Befund am Handgelenk") for k, q in asked.items()][::turn]
    got = reply_defects.defects(reply_defects.replies(spark.createDataFrame(rows, SAMPLE).coalesce(1), spark.createDataFrame([], "result_id long, question string, prediction string")))
    assert {r.record_key: r.defect for r in got.collect()} == {"en": "other_language"}


def _pairs(spark, rows):
    return reply_defects.replies(spark.createDataFrame(rows, SAMPLE), spark.createDataFrame([], "result_id long, question string, prediction string"))


def test_defects_whatever_a_task_holds(spark):
    """Endings that no task holds are joined; the rows are the same, however few are held."""
    rng = random.Random(12)
    rows = []
    for i in range(900):
        t = f"The {rng.choice(['cyst', 'mass', 'tear'])} lies in the {rng.choice(['left', 'right'])} {rng.choice(['lung', 'knee', 'orbit'])}, about {i % 9} mm from the rim of name{i % 200}"
        rows.append((f"s{i}", "Where is it?", t if i % 5 else t[: rng.randint(1, len(t) - 1)]))
    want = {tuple(r) for r in reply_defects.defects(_pairs(spark, rows)).collect()}
    assert sum(d == "truncated" for _, _, d in want) > 50
    for most in (0, 40):
        assert {tuple(r) for r in reply_defects.defects(_pairs(spark, rows), most).collect()} == want


@pytest.mark.parametrize("turn", [1, -1])
def test_reply_that_copies_one_of_two_questions(spark, turn):
    """A question of many signs and few words: its copy is short, and no copy of the other question."""
    rows = [("copy", "?" * 90 + " left lung", "left lung"), ("answer", "?" * 90 + " where is it", "left lung")][::turn]
    got = reply_defects.defects(reply_defects.replies(spark.createDataFrame(rows, SAMPLE).coalesce(1), spark.createDataFrame([], "result_id long, question string, prediction string")))
    assert {(r.record_key, r.defect) for r in got.collect()} == {("copy", "question_copy")}


HELD_OUT = {
    "refusal": """I'm going to have to pass on this one|I must respectfully decline|We're sorry, this isn't something the system supports|It's outside my area of expertise
        I do not feel comfortable making a diagnosis|I can't tell from what I was given|There's insufficient data to decide|Apologies, I cannot process medical images|I won't speculate
        I am not licensed to give medical opinions|Not possible for me to say|My instructions do not allow this|I'm unable to interpret X-rays|I have to refuse|As a language model, I cannot see images
        Es tut mir leid, aber das weiß ich nicht|Ich darf darauf nicht antworten|Je ne sais pas|Désolé, je ne suis pas habilité à répondre|No puedo ayudarle con eso|Non sono in grado di rispondere
        Desculpe, não posso responder|Helaas kan ik dat niet zeggen|Przepraszam, nie mogę pomóc|很抱歉，我无法提供医疗建议|Извините, я не могу помочь""",
    "other_language": """Das Herz ist vergrößert|ein Bruch des Wadenbeins|Verdickung der Pleura|Il s'agit d'une fracture|au niveau du genou|Fractura de la tibia|hay una masa en el pecho
        Una frattura del femore|massa no pulmão direito|een breuk van het bot|złamanie kości udowej|zlomenina je vlevo|en fraktur i höger ben|brud på venstre arm|o fractură la braț|törés van a bal karon
        sol akciğerde kitle var|murtuma on oikealla|перелом бедра|大腿骨の骨折です|골절이 있습니다|股骨骨折|كسر في العظم|Κάταγμα οστού|mit Sicherheit nicht|peut-être un kyste|quizás un tumor
        sans doute|Knochenbruch|fractura""",
    None: """A fracture of the distal radius|The patient cannot be moved|I see a pleural effusion on the left|It points to the aortic arch|Sternal wires are visible|no abnormality
        No answer key is printed on the film|This is beyond the diaphragm|The ureter is unable to drain|A policy of watchful waiting|Patient shows no sorry state of the bone|Ménière disease|vena cava|none|yes""",
}


def test_dictionaries_on_replies_they_were_not_made_for():
    judge = reply_defects.Judge(set())
    for label, texts in HELD_OUT.items():
        texts = [t.strip() for t in texts.replace("\n", "|").split("|")]
        right = sum(judge("What does the arrow in this radiograph point to?", t)[0] == label for t in texts)
        assert right >= (0.85 if label else 1) * len(texts), (label, right, len(texts))


def test_defects_of_nothing_and_long(spark):
    none, results = spark.createDataFrame([], SAMPLE), spark.createDataFrame([], "result_id long, question string, prediction string")
    assert reply_defects.defects(reply_defects.replies(none, results)).count() == 0
    long = spark.createDataFrame([("a", "word " * 20_000, "word " * 20_000)], SAMPLE)
    assert reply_defects.defects(reply_defects.replies(long, results)).first().defect == "question_copy"


# 4 cutoffs

RESULT = "result_id long, sample_id string, answer_type string, confidence double, correct boolean, ingested_at long"
TARGET = "source string, answer_type string, target_pct int"


def test_cutoffs_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, f"a_b_val_{i}" if i % 3 else f"c_test_{i}", rng.choice(["open", "OPEN ", None, "closed"]), rng.choice([0.0, -0.0, 0.5, 0.25, 1.0, rng.random()]), rng.random() < 0.5, 1) for i in range(400)]
    rows += [(900, "a_b_val_1", "open", 1.5, True, 1), (901, "a_b_val_1", "open", float("nan"), True, 1), (902, "a_b_val_1", "open", None, True, 1), (903, "a_b_val_1", "open", 1.0, None, 1), (1, "a_b_val_1", "open", 0.9, True, 2), (904, None, None, 0.5, True, 1)]
    targets = [("a_b", "open", 45), ("a_b", "Closed", 80), ("c", None, 100), ("c", "closed", 0), ("none", "open", 50), ("a_b", "open", None)]
    df = spark.createDataFrame(rows, RESULT).withColumns(clash("score", "part"))
    scored, t = cutoff.scored_results(df), spark.createDataFrame(targets, TARGET)
    groups = {}
    for i, s, k, c, ok, _ in sorted(rows, key=lambda r: r[-1], reverse=True):
        if s and c is not None and ok is not None and 0 <= c <= 1:
            groups.setdefault((s.rsplit("_", 2)[0], (k or "open").strip().lower()), {})[i] = (c + 0.0, ok)
    want = {}
    for s, k, pct in targets:
        g = groups.get((s, (k or "open").lower()))
        if g and pct is not None:
            order = sorted((c for c, _ in g.values()), reverse=True)
            want[s, (k or "open").lower()] = next((x for j, x in enumerate(order) if sum(c >= x for c in order) * 100 >= pct * len(order)), None)
    got = {(r.source, r.answer_type): r for r in cutoff.cutoffs(scored, t).collect()}
    assert {k: r.cutoff for k, r in got.items()} == want
    for k, r in got.items():
        kept = [ok for c, ok in groups[k].values() if c >= r.cutoff]
        assert (r.n_kept, r.n_kept_correct) == (len(kept), sum(kept))
    assert cutoff.kept_results(scored, t).count() == sum(r.n_kept for r in got.values())
    assert cutoff.cutoffs(scored.limit(0), t).count() == 0


# 5 copies hidden by format


def test_copies(spark):
    samples = spark.createDataFrame(
        [("b", "Is IT?", "Yes."), ("b", "Is IT?", "Yes."), ("c", "is  it", "YES"), ("d", "is it", ""), ("e", "is it", None), ("f", "x" * 50_000, "y"), (None, "is it", "yes")], SAMPLE
    ).withColumns(clash("canon"))
    raw = spark.createDataFrame(
        [("a", '{"answer" : "yes", "question": "is\\u00a0it"}'), ("g", None), ("h", "no json"), ("i", "{}"), ("j", '{"question":"x","answer":"y"}'), ("k", '{ "answer":"Y!","x":1,"question":"X"}')], "sample_id string, payload string"
    )
    records = format_copies.qa_records(samples, raw)
    assert {tuple(r) for r in format_copies.copies(records).collect()} == {("a", "b"), ("a", "c"), ("j", "k")}
    got = {r.kept_id: (r.n_copies, r.n_forms) for r in format_copies.collapsed(records).collect()}
    assert got == {"a": (3, 3), "j": (2, 2), "f": (1, 1)}
    assert format_copies.copies(records.limit(0)).count() == 0


# 6 near-duplicates

TEXT = "doc_id long, text string, attribute string"


def near_truth(rows):
    sets = {}
    for i, t, _ in rows:
        w = WORD.findall((t or "").lower())
        if len(w) >= 3 and i is not None:
            sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 10 >= 6 * len(sets[a] | sets[b])}


def test_near_pairs_and_groups(spark):
    rng = random.Random(9)
    rows = []
    for i in range(150):
        if rows and rng.random() < 0.5:
            w = (rng.choice(rows)[1] or "a b c d").split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(999)}"
        else:
            w = [f"v{rng.randrange(400)}" for _ in range(rng.randint(20, 60))]
        rows.append((i, " ".join(w), " A "))
    rows += [(900, None, None), (901, "", "x"), (902, "one two", None), (903, "ONE, two; three", None), (904, "one two three", None), (905, "one two " * 20_000, None), (None, "one two three", None)]
    docs = spark.createDataFrame(rows, TEXT).withColumns(clash("class", "sig", "rep", "key"))
    got = [tuple(r) for r in near_groups.document_pairs(docs).collect()]
    truth = near_truth(rows)
    assert len(got) == len(set(got)) and set(got) <= truth
    assert len(set(got)) >= 0.99 * len(truth) and (903, 904) in got
    groups = {r.doc_id: r.group_id for r in near_groups.document_groups(docs).collect()}
    assert set(groups) == {i for i, t, _ in rows if i is not None and len(WORD.findall(t or "")) >= 3}
    parent = {i: i for i in groups}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in got:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert groups == {i: root(i) for i in parent}
    assert near_groups.document_pairs(docs.limit(0)).count() == 0


def test_near_pairs_of_hot_keys(spark, monkeypatch):
    """Set phrases with a few changed words: keys of all documents, met in blocks, with the same pairs."""
    monkeypatch.setattr(near_groups, "BLOCK", 7)
    phrase = [f"set{i}" for i in range(40)]
    rng = random.Random(3)
    rows = []
    for i in range(60):
        w = list(phrase)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(40)] = f"own{rng.randrange(9)}"
        rows.append((i, " ".join(w), None))
    docs = spark.createDataFrame(rows, TEXT)
    _, reps = near_groups.classes(docs)
    pairs = lambda hot: sorted(tuple(r)[:2] for r in near_groups.class_pairs(docs, reps, hot).collect())
    assert not near_groups._hot_keys(reps, 10**6).count() and near_groups._hot_keys(reps, 10).count() > 10
    assert len(pairs(10**6)) > 100 and pairs(10) == pairs(10**6)


def test_expanded_in_blocks(spark):
    pairs = spark.createDataFrame([(1, 5), (2, 5)], "c long, d long")
    members = spark.createDataFrame([(i, 1 if i < 40 else 2) for i in range(43)], "m long, c long")
    sizes = members.groupBy("c").count()
    want = sorted(map(tuple, expanded(pairs, members, "c", sizes).select("m", "c", "d").collect()))
    assert len(want) == 43 and sorted(map(tuple, expanded(pairs, members, "c", sizes, 6).select("m", "c", "d").collect())) == want


def test_hamming_guarantee():
    """Signatures at most LIMIT values apart share the needed number of keys."""
    rng = np.random.default_rng(2)
    n = near_groups.CHUNKS * near_groups.PARTS
    for _ in range(300):
        wrong = np.zeros(n, bool)
        wrong[rng.choice(n, near_groups.LIMIT, replace=False)] = True
        errors = wrong.reshape(near_groups.CHUNKS, near_groups.PARTS).sum(1)
        assert (errors == 0).sum() * near_groups.PARTS + (errors == 1).sum() >= near_groups.LEAST_KEYS


# 7 packing


def counts(spark, sizes):
    return spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long").withColumns(clash("block"))


def test_containers(spark):
    rng = random.Random(4)
    sizes = [rng.choice([0, 1, 5, 300, 511, 512, 1024, 1025, 5000, rng.randint(1, 900)]) for _ in range(2500)]
    rows = packing.containers(counts(spark, sizes)).collect()
    held, parts = {}, {}
    for r in rows:
        held[r.container_id] = held.get(r.container_id, 0) + r.n_tokens
        parts.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
    assert max(held.values()) <= 1024 and sum(held.values()) == sum(sizes)
    for i, s in enumerate(sizes):
        spans = sorted(parts.get(i, []))
        assert [a for a, _ in spans] == list(range(0, s, 1024)) and sum(n for _, n in spans) == s
    assert sum(sizes) / (len(held) * 1024) > 0.95
    assert packing.containers(counts(spark, [0])).count() == 0
    twice = spark.createDataFrame([(1, 2500), (1, 2500), (1, 1500)], "doc_id long, n_tokens long")
    held = {r.container_id: r["n"] for r in packing.containers(twice).groupBy("container_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert max(held.values()) <= 1024 and sum(held.values()) == 6500 and sum(k.startswith("full") for k in held) == 5


def test_differencing():
    two = packing.differencing(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(s for s, _ in two) == [14, 16]
    assert packing.windows_of(np.array([600] * 5), 1024) and len(packing.windows_of(np.array([600] * 5), 1024)) == 5
    assert packing.windows_of(np.array([512] * 6), 1024) and len(packing.windows_of(np.array([512] * 6), 1024)) == 3


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "a cat"), (2, None), (3, ""), (None, "a cat")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in packing.token_counts(df).collect()} == {1: 2, 2: 0, 3: 0}


# 8 leaks

ITEM = "item_id long, dataset string, passage string, question string, answer string"


def leak_truth(docs, items):
    grams = {}
    for i, _, p, q, _ in items:
        for t in (p, q):
            w = WORD.findall((t or "").lower())
            for k in range(len(w) - 11):
                grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    out = set()
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for k in range(len(w) - 11):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + 12]), ())}
    return out


@pytest.mark.parametrize("block", [4000, 7])
def test_leaks_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(eval_leaks, "BLOCK_ITEMS", block)
    rng = random.Random(8)
    vocabulary = [f"t{i}" for i in range(90)]
    items = [(i, "d", " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 80))), " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 20))), "t1") for i in range(40)]
    items += [(90, "d", None, None, None), (None, "d", "t1 " * 20, "", ""), (91, "d", "", "", ""), (92, "d", items[0][2], None, None)]
    docs = []
    for d in range(60):
        w = [rng.choice(vocabulary + ["zz", "yy"]) for _ in range(rng.randint(0, 120))]
        source = rng.choice(items)[2] or ""
        s = source.split()
        if len(s) > 16:
            k, n = rng.randint(0, len(s) - 14), rng.randint(11, 14)
            w[10:10] = [x.upper() + "," for x in s[k : k + n]]
        docs.append((d, " ".join(w)))
    docs += [(900, None), (901, ""), (902, "t1 " * 5000), (None, items[0][2])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns(clash("kind", "words", "n"))
    it = spark.createDataFrame(items, ITEM)
    got = [tuple(r) for r in eval_leaks.leaks(df, it).collect()]
    assert len(got) == len(set(got)) and set(got) == {(d, i) for d, i in leak_truth(docs, items) if d is not None and i is not None}


def test_leaks_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "d", "a " * 20, "q", "x")], ITEM)
    assert eval_leaks.leaks(docs, items.limit(0)).count() == 0
    assert eval_leaks.leaks(docs.limit(0), items).count() == 0


def test_paraphrase(spark):
    passage = "the quick surgeon removed a large calcified nodule from the upper left lobe while the junior nurse held the lamp and counted every instrument twice"
    w = passage.split()
    w[3], w[15] = "extracted", "assistant"
    items = spark.createDataFrame([(1, "d", passage, "q", "nodule")], ITEM)
    docs = spark.createDataFrame([(1, " ".join(w[4:])), (2, "something else altogether")], "doc_id long, text string")
    got = eval_leaks.paraphrases(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.has_answer) for r in got] == [(1, 1, True)]
    assert eval_leaks._lcs(np.array([1, 2, 3, 4]), np.array([2, 4, 9])) == 2


def paraphrase_truth(docs, items):
    """(doc_id, item_id): the best share of a window of WINDOW words in a span of as many, by plain comparison."""
    cut_up = lambda w, step: [w[s : s + 24] for s in sorted({*range(0, max(1, len(w) - 23), step), max(0, len(w) - 24)})]
    number, out = {}, {}
    words = lambda t: np.array([number.setdefault(x, len(number)) for x in re.findall(r"[^\W_]+", t.lower())])
    for item, _, *texts, _ in items:
        windows = [w for t in texts for w in cut_up(words(t), eval_leaks.ITEM_STEP) if len(w) >= 12]
        for doc, text in docs:
            best = max((eval_leaks._lcs(w, s) / len(w) for w in windows for s in cut_up(words(text), 1)), default=0)
            if best >= 0.7:
                out[doc, item] = best
    return out


def test_paraphrases_with_foreign_words_against_brute_force(spark):
    rng = random.Random(9)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(400)]
    text = lambda n: [rng.choice(common if rng.random() < 0.6 else rare) for _ in range(n)]
    items = [(i, "d", " ".join(text(rng.choice((12, 19, 30, 61)))), " ".join(text(14)), "x") for i in range(12)]
    docs = []
    for d in range(40):
        w = rng.choice(items)[2].split()
        w = w[rng.randrange(max(1, len(w) - 24)) :]
        for k in range(rng.randrange(5), len(w), rng.choice((4, 5, 6, 11))):  # no twelve known words in a row
            w[k] = f"foreign{k}"
        docs.append((d, " ".join([*text(rng.randrange(30)), *w, *(["x"] if d % 2 else [])])))
    truth = paraphrase_truth(docs, items)
    assert 10 < len(truth) < 200
    got = eval_leaks.paraphrases(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEM)).collect()
    assert {(r.doc_id, r.item_id): round(r.lcs_share, 6) for r in got} == {k: round(v, 6) for k, v in truth.items()}
    assert all(-1.001 <= r.cosine <= 1.001 for r in got)


def test_paraphrases_at_every_place(spark):
    words = [f"w{i}" for i in range(70)]
    items = spark.createDataFrame([(1, "d", " ".join(words), "q", None)], ITEM)
    docs = []
    for start in range(len(words) - 23):  # 24 words of the item from anywhere, seven of them replaced, anywhere in the text
        w = words[start : start + 24]
        for k in (2, 5, 8, 11, 14, 17, 20):
            w[k] = "foreign"
        docs.append((start, " ".join(["before"] * (start % 13) + w + ["after"] * (start % 5))))
    got = eval_leaks.paraphrases(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert sorted((r.doc_id, r.lcs_words) for r in got) == [(d, 17) for d, _ in docs]


def test_paraphrase_answer_in_the_whole_text(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    items = spark.createDataFrame([(1, "d", passage, "q", "Rare word"), (2, "d", passage, "q", "w3 rare")], ITEM)
    docs = spark.createDataFrame([(1, f"{passage} foreign words, then a rare word."), (2, f"{passage} rare, then a word")], "doc_id long, text string")
    got = eval_leaks.paraphrases(docs, items).collect()
    assert {(r.doc_id, r.item_id): r.has_answer for r in got} == {(1, 1): True, (2, 1): False, (1, 2): False, (2, 2): False}


# 9 subjects


def subject_tables(spark, docs, labels):
    return (
        spark.createDataFrame(docs, "doc_id long, text string").withColumns(clash("subject", "words")),
        spark.createDataFrame(labels, "doc_id long, subject string, annotator string"),
        spark.createDataFrame([("chest", "x"), ("patient_law", "y")], "subject string, description string"),
        spark.createDataFrame([(i, "d", f"A {i}-year-old sailor was sent for ct after {i} weeks of pain and the panel reviewed it.", "Which structure near the clip is older?", None) for i in range(40)], ITEM),
    )


def test_held_out_accuracy(spark):
    rng = random.Random(6)
    said = {
        "chest": [f"The {a} lobe may show {b} when {c}." for a in ("upper", "lower", "middle") for b in ("air trapping", "septal lines") for c in ("oxygen drops", "the cough stays")],
        "patient_law": [f"The {a} mentions a {b} because {c}." for a in ("consent form", "court order", "contract") for b in ("breach", "waiver") for c in ("the judge asks", "the trial ends")],
    }
    case = "A 30-year-old sailor was sent for ct after 4 weeks of pain and the panel reviewed it."
    docs, truth = [], {}
    for i in range(240):
        kinds = rng.choice([["chest"], ["patient_law"], ["chest", "patient_law"]])
        parts = [rng.choice(said[k]) for k in kinds for _ in range(4)]
        if len(kinds) == 1 and rng.random() < 0.5:  # one in nine statements of the other
            parts = [rng.choice(said[kinds[0]]) for _ in range(8)] + [rng.choice(said["chest" if kinds[0] != "chest" else "patient_law"])]
        docs.append((i, " ".join([*parts, case])))
        truth[i] = set(kinds)
    labels = [(i, rng.choice(["Chest", "CHEST", "chest"]) if k == "chest" else rng.choice(["patient law", "patient_law"]), "a") for i in range(120) for k in truth[i]]
    labels += [(0, "nonsense", "b"), (1, None, "b"), (None, "chest", "b")]
    docs += [(900, None), (901, ""), (902, case), (903, said["chest"][0] * 300), (None, said["chest"][0])]
    got = {}
    for r in subjects.document_subjects(*subject_tables(spark, docs, labels)).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held = range(120, 240)
    assert sum(got.get(i) == truth[i] for i in held) / len(held) >= 0.9
    assert got[903] == {"chest"} and not {900, 901, 902, None} & set(got)


def test_subjects_without_labels(spark):
    assert subjects.document_subjects(*subject_tables(spark, [(1, "x y")], [(5, "chest", "a")])).count() == 0


# shared


def test_cut_keeps_rows_until_released(spark):
    kept = cut(spark.range(5))
    path = shared._written[-1][1]
    assert kept.count() == 5 and os.path.isdir(path)
    shared.release()
    assert not os.path.exists(path) and not shared._written
