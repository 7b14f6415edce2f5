"""Conversation repair, license scan and token alignment against plain versions, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pagegauge.llm import conversation_repair as repair
from pagegauge.llm import license_scan as licenses
from pagegauge.llm import queries
from pagegauge.llm import token_alignment as alignment
from pagegauge.llm.tables import read

from .brute import ALNUM, LOWER, sha

# conversation repair ------------------------------------------------------------------------------------------------

GRAMMAR, PREFIX = re.compile(r"(s?(ua)+)?"), re.compile(r"s?(ua)*u?")


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Every sequence of edits that can still fit the grammar, of which the least (cost, audit) is taken."""
    faults, best = faults_of(rows), []
    inserts = [()] + [(a,) for a in "ua"] + [(a, b) for a in "ua" for b in "ua"]

    def go(k, cost, audit, letters, lines):
        for some in inserts:
            now, c, a = letters + "".join(some), cost + 3 * len(some), audit + "I" * len(some)
            if not PREFIX.fullmatch(now):
                continue
            wrote = lines + tuple(f"{'user' if x == 'u' else 'assistant'}:" for x in some)
            if k == len(rows):
                if GRAMMAR.fullmatch(now):
                    best.append((c, a, wrote))
                continue
            role, text = rows[k]
            go(k + 1, c + 4, a + "D", now, wrote)
            if faults[k] in ("blank", "duplicate"):
                continue
            more = 3 if faults[k] == "truncated" else 0
            ways = [(role[:1], more, "K", role)] if role else []
            for letter, to, extra, edit, name in [(x, x, m, e, r) for x, m, e, r in ways] + [("u", "u", 3 + more, "R", "user"), ("a", "a", 3 + more, "R", "assistant")]:
                if PREFIX.fullmatch(now + to):
                    go(k + 1, c + extra, a + edit, now + to, (*wrote, f"{name}:{text}"))

    go(0, 0, "", "", ())
    return min(best)


def conversation(rows):
    x = repair._Conversation(1)
    for k, ((role, text), fault) in enumerate(zip(rows, faults_of(rows), strict=True)):
        x.read(k, role, text, fault)
    return x.result()


def test_repair_is_the_cheapest():
    rng = random.Random(3)
    for _ in range(250):
        rows = [(rng.choice(["user", "assistant", "system", "tool", "usr", ""]), rng.choice(["a.", "b.", "c", "", "d!"])) for _ in range(rng.randint(0, 4))]
        cost, audit, lines = cheapest(rows)
        _, _, got_cost, got_audit, digest = conversation(rows)
        assert (got_cost, got_audit, digest) == (cost, audit, sha("\n".join(lines))), rows


def test_repair_settles_without_a_difference(monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice(["user", "assistant", "system"]), f"{rng.randrange(2000)}{rng.choice('.! ')}") for _ in range(3_000)]
    whole = conversation(rows)
    monkeypatch.setattr(repair._Conversation, "SETTLE", 5)
    again = conversation(rows)
    assert whole == again and len(again[3].replace("I", "")) == 3_000


CONVERSATIONS = "conv_id long, turn long, role string, text string, position long, fault string"
ODD = [
    (1, 0, "user", "q.", 1, "x"), (1, 0, "user", "q.", 1, "x"), (1, 2, "assistant", "a.", 1, "x"), (2, None, "user", "q?", 1, "x"), (2, 4, None, None, 1, "x"), (3, 1, "", "text.", 1, "x"),
    (None, 0, "user", "q.", 1, "x"), (None, 0, "assistant", "a", 1, "x"), (4, 0, "system", "s.", 1, "x"), (5, 0, "user", "long " * 100_000 + ".", 1, "x"), (6, None, None, None, None, None),
]


def test_repair_of_odd_rows(spark):
    rows = spark.createDataFrame(ODD, CONVERSATIONS).repartition(3)
    got = {r["conv_id"]: r for r in repair.repair(rows).collect()}
    # in the order of role and text; a second equal row is a duplicate
    assert (got[1]["gaps"], got[1]["duplicate"], got[1]["cost"], got[1]["audit"]) == (1, 1, 4, "KDK")
    assert (got[2]["gaps"], got[2]["blank"], got[2]["illegal"]) == (0, 1, 1) and got[2]["audit"] == "KDI"
    assert got[3]["audit"] == "D" and got[3]["repaired_sha256"] == sha("")
    assert got[None]["truncated"] == 1
    assert got[4]["audit"] == "D" and got[5]["audit"] == "KI" and got[5]["repaired_sha256"] == sha("user:" + "long " * 100_000 + ".\nassistant:")
    assert got[6]["blank"] == 1
    assert repair.repair(rows.limit(0)).collect() == []


def test_repaired_rows_are_what_was_hashed(spark, sf_dir):
    rows = queries.damaged(read(spark, sf_dir, "conversations")).where("alive").drop("alive", "copy")
    rows = rows.unionByName(spark.createDataFrame([(-5, 0, "user", "q."), (-6, 0, "system", "s."), (-6, 1, "user", "u."), (-7, 0, "user", "")], "conv_id long, turn long, role string, text string"))
    digests = {r["conv_id"]: r["repaired_sha256"] for r in repair.repair(rows).collect()}
    lines = defaultdict(list)
    for r in repair.repaired_rows(rows).orderBy("conv_id", "position").collect():
        assert r["position"] == len(lines[r["conv_id"]])
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {c: sha("\n".join(lines[c])) for c in digests} == digests


def test_repair_query_keeps_every_conversation(spark, sf_dir):
    got = queries.op11_conversation_repair(spark, sf_dir).collect()
    assert len(got) == read(spark, sf_dir, "conversations").select("conv_id").distinct().count()


# license scan -------------------------------------------------------------------------------------------------------

SMALL = (
    licenses.Template("mit", "mit license", True),
    licenses.Template("gpl", "general public license", True),
    licenses.Template("both", "may use <<beginOptional>>and <<beginOptional>>freely<<endOptional>> copy<<endOptional>> it <<var;min=1;max=3>> free <<beginOptional>>now<<endOptional>> ok"),
    licenses.Template("tail", "may use it <<var;min=0;max=2>> ok"),
)


def as_pattern(t):
    out = ""
    for part in re.findall(r"<<[^>]*>>|\w+", t.markup.lower()):
        n = re.fullmatch(r"<<var;min=(\d+);max=(\d+)>>", part)
        out += "(?:" if part == "<<beginoptional>>" else ")?" if part == "<<endoptional>>" else f"(?: [^ ]+){{{n[1]},{n[2]}}}" if n else f" {part}"
    return re.compile(out)


def plain_matches(text, templates):
    words = ALNUM.findall((text or "").translate(LOWER))
    found = []
    for k, t in enumerate(templates):
        pattern = as_pattern(t)
        for i in range(len(words)):
            for j in range(i + 1, min(len(words), i + 60) + 1):
                if pattern.fullmatch("".join(f" {w}" for w in words[i:j])):
                    found.append((i, j, k))
                    break
    return len(words), sorted(found)


def test_templates_match_like_patterns(spark):
    rng = random.Random(5)
    words = "may use and freely copy it free now ok x mit license general public".split()
    rows = [(k, " ".join(rng.choice(["", "-"]) + rng.choice(words) for _ in range(rng.randint(0, 30)))) for k in range(150)]
    rows += [(k, "May use and FREELY copy, it: a b free ok. may use it x ok may use and copy it x free now ok") for k in range(150, 153)] + [(200, None), (201, ""), (None, "mit, license"), (201, "the MIT-License é " * 40_000)]
    got = licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string").withColumn("matches", F.lit(1)).repartition(3), SMALL).collect()
    order = {t.label: k for k, t in enumerate(SMALL)}
    seen = Counter((r["doc_id"], r["n_words"], tuple((m["start"], m["end"], order[m["label"]]) for m in r["matches"])) for r in got)
    want = Counter((d, n, tuple(m)) for d, t in rows if len(t or "") < 1000 for n, m in [plain_matches(t, SMALL)])
    want[201, 160_000, tuple((4 * i + 1, 4 * i + 3, 0) for i in range(40_000))] += 1
    assert seen == want


def test_templates_that_cannot_be_compiled():
    for markup in ("one", "<<beginOptional>>a<<endOptional>> b c", "a b <<beginOptional>> c", "a b c <<endOptional>>", "a b <<var;min=3;max=1>> c"):
        with pytest.raises(ValueError):
            licenses.compiled(licenses.Template("x", markup))


def test_license_templates_accept_their_own_wording():
    for t in licenses.TEMPLATES:
        for optional in (True, False):
            text = re.sub(r"<<var;min=(\d+);max=(\d+)>>", lambda m: " holder" * int(m[2 if optional else 1]), t.markup)  # noqa: B023
            text = re.sub(r"<<(begin|end)Optional>>", " ", text) if optional else re.sub(r"<<beginOptional>>.*?<<endOptional>>", " ", text, flags=re.S)
            words = ALNUM.findall(text.translate(LOWER))
            assert licenses.compiled(t).accepts(iter(words)) == len(words), t.label
            assert licenses.compiled(t).accepts(iter([*words[:-1], "wrong"])) is None, t.label


def test_license_scores(spark):
    found = licenses.find_licenses(spark.createDataFrame([(1, "Released under the MIT License."), (2, "nothing here"), (3, None)], "doc_id long, text string"))
    got = {r["doc_id"]: (r["s"], r["l"]) for r in found.select("doc_id", licenses.score_of(F.col("n_words"), F.col("matches")).alias("s"), licenses.labels_of(F.col("matches")).alias("l")).collect()}
    assert got == {1: (1.0, "mit,mit-notice"), 2: (0.0, ""), 3: (0.0, "")}


# token alignment ----------------------------------------------------------------------------------------------------


def plain_alignment(texts):
    """Per text ids, groups and links from the bytes, one by one."""
    t = alignment.tokenizers(alignment.A_FILE, alignment.B_FILE)
    out = []
    for text in texts:
        sides = []
        for ids, of in ((t.a.encode(f" {text or ''}", add_special_tokens=False).ids, t.a_bytes), (t.b.encode(text or ""), t.b_bytes)):
            at, spans = 0, []
            for i in ids:
                spans.append((at, at + len(of[i]), i))
                at += len(of[i])
            sides.append((spans, b"".join(of[i] for i in ids)))
        whole = f" {text}".encode() if text else None
        a, b = ([s for s, joined in sides if joined == whole] + [None, None])[:2] if all(joined == whole for _, joined in sides) else ([], [])
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, at = [], 0
        for e in ends:
            groups.append((at, [i for s, f, i in a if at <= s and f <= e], [i for s, f, i in b if at <= s and f <= e]))
            at = e
        links = [(i, j) for s, e, i in a for x, y, j in b if s < y and x < e]
        out.append((len(a), len(b), groups, links))
    return out


def plain_rows(rows):
    found = plain_alignment([t for _, t in rows])
    count = Counter(p for *_, links in found for p in set(links))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (d, _), (n_a, n_b, groups, links) in zip(rows, found, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for _, a, b in groups)
        out.append((d, n_a, n_b, len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if n_a else ""))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
TEXTS = [
    (1, None), (2, ""), (3, "one"), (3, "one"), (None, "né à 中文 😀 <|endoftext|> </s>\t\n  x"), (None, None), (4, "a▁b is replaced"), (5, "  two  blanks before, and behind  "), (6, " "), (7, "\x00 and \x01"), (8, "word " * 300 + "x"), (9, "1234567890" * 30),
]


def test_alignment_of_odd_texts(spark):
    got = alignment.aligned_documents(spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("pairs", F.lit("x")).repartition(3)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == plain_rows(TEXTS)
    assert alignment.aligned_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert {r["n_links"] for r in alignment.aligned_documents(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()} == {0}


def test_alignment_over_many_pieces(spark, sf_dir, monkeypatch):
    docs = read(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if len(r["text"] or "") < 3_000][:120]
    got = alignment.aligned_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == plain_rows(rows)


def test_long_texts_are_cut_without_a_difference():
    t = alignment.tokenizers(alignment.A_FILE, alignment.B_FILE)
    rng = random.Random(6)
    text = "".join(rng.choice(["word", " ", "  ", "é", " x1", "\n", " don't", "<|endoftext|>", "中", " .", "\t"]) for _ in range(9_000))
    parts = alignment._cut(text, 500)
    assert len(parts) > 20 and " ".join(parts) == text
    ids = [[e.ids for e in t.a.encode_batch([f" {p}" for p in parts], add_special_tokens=False)], t.b.encode(parts)]
    assert [sum(x, []) for x in ids] == [t.a.encode(f" {text}", add_special_tokens=False).ids, t.b.encode(text)]
    assert t.cuts and alignment._cut("x" * 2_000, 500) == ["x" * 2_000]


def test_groups_of_tokens(spark):
    rows = [(d, t) for d, t in TEXTS if d is not None]
    got = defaultdict(list)
    for r in alignment.aligned_groups(spark.createDataFrame([x for x in rows if x[0] != 3], "doc_id long, text string").repartition(2)).orderBy("doc_id", "start").collect():
        got[r["doc_id"]].append((r["start"], r["a_ids"], r["b_ids"]))
    for (d, _), (_, _, groups, _) in zip(rows, plain_alignment([t for _, t in rows]), strict=True):
        if d != 3:
            assert got[d] == groups
