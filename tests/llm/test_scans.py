"""Licence, token, secret and quality scans against plain restatements of their contracts."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

from marginalia.llm import bpe_matrix, entries, license_index, quality_cascade, secret_grammar

from .cases import SF, clashing, documents, empty, odd, odd_rows, rows_of

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def licences(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for p, label in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_licence_base(spark):
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    want = sorted(((r["doc_id"], *licences(r["text"])) for r in documents(spark).collect()), key=repr)
    got = entries.op5_license_index(spark, SF).collect()
    assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == want
    assert all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1 for r in got)
    odd_want = sorted(((r.doc_id, *licences(r.text)) for r in odd_rows()), key=repr)
    for docs in (odd(spark), clashing(spark)):
        assert rows_of(license_index.scan_licenses(docs), *names) == odd_want
    assert license_index.scan_licenses(empty(spark)).count() == 0


def test_licence_alignment_with_a_changed_word():
    index = license_index.Index(license_index.BASE_PHRASES + license_index.NOTICES)
    text = "x y Licensed under the GNU General Public Licence, version 3"
    assert [h[0] for h in index.scan(text.replace("Licence", "License"))[1]] == ["gpl-3"]
    assert index.scan(text)[1] == []  # a key phrase is broken
    assert [h[:2] for h in index.scan("Licensed beneath the GNU General Public License version 3")[1]] == [("gpl-3", 0)]


def plain_labels(text):
    """Every template at every relative position, by the whole alignment, without an index."""
    index = license_index.Index(license_index.BASE_PHRASES + license_index.NOTICES)
    words, found = license_index.words_of(text or ""), set()
    for t, template in enumerate(index.templates):
        for at in range(-len(index.words[t]) + 1, len(words)):
            share, first, end = index.aligned(t, words, at, at)
            if share >= template.least - 1e-9 and all(license_index.holds(words[first:end], k) for k in index.keys[t]):
                found.add(template.label)
    return found


def test_licence_labels_equal_all_alignments(spark):
    """Notices with words changed, lost and inserted, the rarest among them, in other words."""
    rng = random.Random(8)
    notices, rows = [t.text.split() for t in license_index.BASE_PHRASES + license_index.NOTICES], []
    for k in range(80):
        own = list(notices[k % len(notices)])
        for _ in range(rng.randrange(0, max(1, len(own) // 6))):
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice([[], ["other"], [own[at], "new"], ["the"]])
        before, after = (rng.choices("of the and software license version free general 2 3".split(), k=rng.randrange(4)) for _ in range(2))
        rows.append((k, " ".join([*before, *own, *after])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_index.scan_licenses(docs).collect()}
    want = {k: plain_labels(t) for k, t in rows}
    assert {k: set(filter(None, got[k]["labels"].split(","))) for k in got} == want
    assert sum(map(bool, want.values())) > 40


def heaviest_alignment(want, own, weight, offsets):
    """(weight, first, end): by trying, for every pair of places, to take it or to go on, without a table of rows. Earliest of equals."""
    from functools import lru_cache

    @lru_cache(None)
    def best(i, j):
        if i == len(want) or j == len(own):
            return 0.0, 0, 0
        options = [best(i + 1, j), best(i, j + 1)]
        if want[i] == own[j] and j - i in offsets:
            rest, _, last = best(i + 1, j + 1)
            options.append((weight[want[i]] + rest, -j, last if rest else -(j + 1)))
        return max(options, key=lambda o: (round(o[0], 9), o[1], o[2]))

    total, first, last = best(0, 0)
    return total, -first, -last


def test_labels_by_a_plain_alignment(spark):
    """The labels again, by an alignment that shares no code with the index."""
    rng, rows = random.Random(21), []
    templates = [t for t in license_index.NOTICES if len(t.text.split()) < 22]
    df = Counter(w for t in license_index.BASE_PHRASES + license_index.NOTICES for w in set(t.text.split()))
    weight = {w: math.log((1 + len(license_index.BASE_PHRASES + license_index.NOTICES)) / n) + 1 for w, n in df.items()}
    for k in range(30):
        own = templates[k % len(templates)].text.split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice([[], ["other"], [own[at], "new"], ["free"]])
        rows.append((k, " ".join(["some", *own, "license"])))
    want = {}
    for k, text in rows:
        words, found = text.split(), set()
        for t in license_index.BASE_PHRASES + license_index.NOTICES:
            tw = t.text.split()
            slack = 0 if t.least >= 1 else max(2, len(tw) // 8)
            total = sum(weight[w] for w in tw)
            for r in range(-len(tw), len(words)):
                got, first, end = heaviest_alignment(tuple(tw), tuple(words), weight, range(r - slack, r + slack + 1))
                inside = words[first:end]
                if got >= t.least * total - 1e-9 and all(any(inside[i : i + len(x)] == x for i in range(len(inside))) for x in map(str.split, t.keys)):
                    found.add(t.label)
        want[k] = ",".join(sorted(found))
    got = license_index.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["labels"] for r in got} == want
    assert sum(map(bool, want.values())) > 15


def test_the_index_starts_few_alignments_in_vain(monkeypatch):
    index, started = license_index.Index(license_index.BASE_PHRASES + license_index.NOTICES), []
    aligned = index.aligned
    monkeypatch.setattr(index, "aligned", lambda *a: started.append(a) or aligned(*a))
    rng = random.Random(4)
    notices = [t.text for t in license_index.NOTICES]
    common = "this software is provided as is if you want it to be free at any one of the public terms license version copy".split()
    found = sum(len(index.scan(" ".join([*rng.choices(common, k=300), *([rng.choice(notices)] if k % 5 == 0 else []), *rng.choices(common, k=300)]))[1]) for k in range(100))
    assert found >= 20 and len(started) <= 10 * found


def test_every_rare_word_may_change_if_the_rest_stays():
    index = license_index.Index(license_index.BASE_PHRASES + license_index.NOTICES)
    t = next(k for k, x in enumerate(index.templates) if x.label == "zlib")
    words = [w.decode() for w in index.words[t]]
    heavy = sorted(set(words), key=lambda w: (-index.idf[w.encode()], w))
    keep = {w.decode() for k in index.keys[t] for w in k}
    for w in [w for w in heavy if w not in keep][:3]:
        assert "zlib" in {h[0] for h in index.scan(" ".join("changed" if x == w else x for x in words))[1]}


def test_tokens_equal_tiktoken(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe_matrix.load_ranks(path)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def want(doc_id, text):
        ids = known.encode_ordinary(text or "")
        return doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    got = entries.op6_bpe_matrix(spark, SF)
    assert rows_of(got, *names) == sorted((want(r["doc_id"], r["text"]) for r in documents(spark).collect()), key=repr)
    for docs in (odd(spark), clashing(spark)):
        got = bpe_matrix.encode(docs, path, public_tokenizers.PATTERN, digest=True)
        assert rows_of(got, *names) == sorted((want(r.doc_id, r.text) for r in odd_rows()), key=repr)
    whole = bpe_matrix.encode(odd(spark), path, public_tokenizers.PATTERN).collect()
    assert {bytes(r["decoded"]) for r in whole} == {(r.text or "").encode() for r in odd_rows()}
    assert bpe_matrix.encode(empty(spark), path, public_tokenizers.PATTERN).count() == 0


def base_secrets(text):
    text = text or ""
    assign = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    found.sort()
    n = [sum(f[1] == k for f in found) for k in range(3)]
    return (*n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in found).encode()).hexdigest())


def test_secret_base(spark):
    names = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    got = entries.op7_secret_grammar(spark, SF)
    assert rows_of(got, *names) == sorted(((r["doc_id"], *base_secrets(r["text"])) for r in documents(spark).collect()), key=repr)
    for docs in (odd(spark), clashing(spark)):
        assert rows_of(secret_grammar.scan_secrets(docs), *names) == sorted(((r.doc_id, *base_secrets(r.text)) for r in odd_rows()), key=repr)
    assert secret_grammar.scan_secrets(empty(spark)).count() == 0
    clean = secret_grammar.redact(clashing(spark))
    assert clean.columns == clashing(spark).columns
    by = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert by[10] == "[SECRET] [SECRET] [SECRET]" and by[1] is None and by[2] == ""


def test_inferred_formats():
    """Credentials of a known format, though never seen, are found; words, paths and other codes are not."""
    grammar = secret_grammar.Grammar(secret_grammar.labelled_examples())
    unseen = secret_grammar.labelled_examples(20, seed=99)
    assert np.mean([bool(secret_grammar.scan_text(f"x {c} y", grammar)) for _, c in unseen]) > 0.95
    for text in ("src/module/file-name_version2.txt", "2024-01-02T03:04:05.000", "internationalisation-2nd-edition", "1234567890123456"):
        assert secret_grammar.scan_text(text, grammar) == []


def test_formats_that_only_the_corpus_knows(spark):
    """Values assigned in some documents teach a format, which is then found bare in others; other identifiers aren't."""
    rng = random.Random(4)
    own = lambda: "zq" + "".join(rng.choices("ABCDEFGHJK", k=6)) + "_" + "".join(rng.choices("0123456789abcdef", k=20))
    rows = [(k, f'some words api_key = "{own()}" more words') for k in range(120)]
    bare = {1000 + k: own() for k in range(100)}
    rows += [(k, f"see {v} there") for k, v in bare.items()]
    other = {2000 + k: x for k, x in enumerate(["src/module/file-name_version2.txt", "550e8400-e29b-41d4-a716-446655440000", "2024-01-02T03:04:05.000Z-host1", "internationalisation-2nd-edition", "v1.2.3-rc4-build.20240102"])}
    rows += list(other.items())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["found"] for r in secret_grammar.scan_secrets(docs).collect()}
    whole = lambda found, k: any(f["start"] <= 4 and f["end"] >= 4 + len(bare[k]) for f in found)
    assert sum(whole(found[k], k) for k in bare) >= 90
    assert not any(found[k] for k in other)
    alone = secret_grammar.scan_secrets(docs, secret_grammar.labelled_examples()).collect()
    assert sum(whole(r["found"], r["doc_id"]) for r in alone if r["doc_id"] in bare) < 10  # the documented formats don't cover it


def plain_stretches(text, grammar, least):
    """All candidate stretches of every run, scored as whole strings; of each kind and start the last end that scores enough."""
    taken = [(s, e) for s, _, e in secret_grammar.base_spans(text)]
    found = []
    for run in re.finditer(r"[A-Za-z0-9+/_.=-]{16,}", text):
        own, final = run[0], len(run[0].rstrip(".="))
        best = {}
        for kind in grammar.automata:
            alone = secret_grammar.Grammar([])
            alone.automata = {kind: grammar.automata[kind]}
            for a in range(final):
                if kind in grammar.prefixed:
                    if own[a] not in grammar.prefixed[kind]:
                        continue
                elif a and own[a - 1].isalnum():
                    continue
                for b in range(a + 16, final + 1):
                    part = own[a:b]
                    if (b == final or not own[b].isalnum()) and re.search("[0-9]", part) and re.search("[A-Za-z]", part):
                        score = alone.score(part)[0]
                        if score >= least:
                            best[kind, a] = (a, b, score, kind)
        for a, b, score, kind in sorted(best.values(), key=lambda x: (x[0] - x[1], -x[2], x)):
            a, b = run.start() + a, run.start() + b
            if not any(s <= a and b <= e for s, e in taken):
                taken.append((a, b))
                found.append((a, f"format-{kind}", b))
    return sorted(found)


def test_spans_equal_all_stretches(spark):
    grammar = secret_grammar.Grammar(secret_grammar.labelled_examples())
    rng = random.Random(9)
    texts = []
    for _, c in secret_grammar.labelled_examples(6, seed=31):
        around = rng.choice(["{}", "x={}", "a/{}/b", "{}-tail9", "id.{}=", "token: {} {}", "//{}@host"])
        texts.append(around.replace("{}", c) + " " + "".join(rng.choices("ab1-/_.=", k=40)))
    rows = list(enumerate(texts))
    got = secret_grammar.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), secret_grammar.labelled_examples()).collect()
    for r in got:
        text = texts[r["doc_id"]]
        added = sorted((f["start"], f["kind"], f["end"]) for f in r["found"] if not f["base"])
        assert added == plain_stretches(text, grammar, 12.0)
        base = secret_grammar.base_spans(text)
        assert [(f["start"], f["kind"], f["end"]) for f in r["found"] if f["base"]] == base


def test_quality_keeps_other_columns(spark):
    got = quality_cascade.apply_cascade(clashing(spark))
    assert {"_words", "_lines"} <= set(got.columns)
    assert {(r["_words"], r["_lines"], r["key"]) for r in got.collect()} == {("extra _words", "extra _lines", "extra key")}


def test_quality_sample_is_of_few_files(spark, tmp_path):
    documents(spark).repartition(12).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    sample = quality_cascade.sampled(docs.select("doc_id", "text"), "text", 1000)
    assert 0 < sample.count() < 0.4 * docs.count()
    assert len(sample.inputFiles()) == 12  # the relation's; the scan reads the chosen ones
    joined = docs.join(docs.select("doc_id").distinct(), "doc_id")
    assert quality_cascade.sampled(joined, "text", 7).count() <= 7


def test_quality_defined_cases(spark):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    def want(r):
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen = Counter(windows)
        inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
        return (r.doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed)

    for docs in (odd(spark), clashing(spark)):
        assert rows_of(quality_cascade.apply_cascade(docs), *names[:-1]) == sorted(map(want, odd_rows()), key=repr)
    assert quality_cascade.apply_cascade(empty(spark)).count() == 0


def test_cascade_order_changes_no_verdict(spark):
    rules = quality_cascade.default_rules()
    stats = quality_cascade.base_stats(documents(spark).select("doc_id", "text"))
    a = stats.select("doc_id", quality_cascade.verdict(rules)[0].alias("kept"))
    b = stats.select("doc_id", quality_cascade.verdict(rules[::-1])[0].alias("kept"))
    assert rows_of(a, "doc_id", "kept") == rows_of(b, "doc_id", "kept")
    planned = quality_cascade.plan_cascade(documents(spark), rules)
    assert sorted(r.name for r, _, _ in planned) == sorted(r.name for r in rules)
