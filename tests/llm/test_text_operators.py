"""Row-wise and line operators against brute force, on odd texts."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from adpace.llm import chat_format, language_id, line_dedup, packing, pii_context, quality_rules, secret_scans
from tests.llm.data import documents, folder, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def span_list(found):
    return [(s.start, s.kind, s.end) for s in found]


# --- chat formatting ----------------------------------------------------------


def chat_rows():
    rng = random.Random(3)
    rows = [(8, 0, "system", "only"), (9, 0, "system", "be brief"), (9, 1, "assistant", "ok"), (9, 1, "assistant", "ok")]
    roles = ["user", "assistant", "system", "as\nsist<|", None]
    said = [None, "", " x ", "<~|im_end|>\n<|", "a <~~~| b\n" + "word " * 400, "é日 <|im_start|>user"]
    for conv in (None, 1, 2, 3):
        for turn in range(rng.choice([1, 30, 700])):
            rows.append((conv, rng.choice([turn, None, turn // 2]), rng.choice(roles), rng.choice(said)))
    return rows


def test_chat_windows_hold_every_turn_once(spark, tmp_path):
    rows = chat_rows()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS window", "'x' AS block")
    probe = "<|im_end|><|im_start|>assistant ok"
    want = {}
    by_conv = defaultdict(list)
    for conv, turn, role, text in [*rows, (-1, 0, "user", probe), (-1, 1, "assistant", probe)]:
        by_conv[conv].append((-(2**63) if turn is None else turn, role or "", text or ""))
    for conv, turns in by_conv.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        want[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = chat_format.op1_chat_format(spark, folder(spark, tmp_path, conversations=table)).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == want


def test_chat_windows_keep_the_budget(spark):
    table = spark.createDataFrame(chat_rows(), "conv_id long, turn long, role string, text string")
    windows = chat_format.windows(table, budget=600, history=100).collect()
    assert any(w.n_context > 1 for w in windows)
    for w in windows:
        assert w.formatted.count("<|im_start|>") == w.n_turns
        assert w.n_tokens <= 600 or w.n_turns - w.n_context == 1
        assert all(w.formatted[:s.start].endswith("<|im_start|>assistant\n") for s in w.loss_spans)


def test_chat_empty_table(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.windows(table).count() == 0


# --- quality rules --------------------------------------------------------------


def test_rule_statistics(spark):
    for r in quality_rules.rule_statistics(documents(spark, [x for x in texts() if x[0] is not None])).collect():
        text = dict(texts())[r.doc_id] or ""
        words = WORD.findall(text)
        windows = Counter(zip(words, words[1:], words[2:]))
        inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words))


def test_forest_rejects_labelled_junk(spark):
    rng = random.Random(1)
    good = [(i, " ".join(f"w{rng.randint(0, 5000)}" if rng.random() < 0.05 else rng.choice("the of and word other".split()) + rng.choice("abcdefgh") * 3 for _ in range(90))) for i in range(200)]
    junk = [(1000 + i, " ".join(f"w{rng.randint(0, 5000)}***" for _ in range(90))) for i in range(30)]
    docs = documents(spark, good + junk)
    labels = spark.createDataFrame([(i, 1 if i < 1000 else 0, 0) for i, _ in (good + junk)[::2]], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality_rules.quality_verdicts(docs, labels).filter("kept").collect()}
    assert not any(i >= 1000 for i in kept) and sum(i < 1000 for i in kept) >= 198
    assert {r.doc_id for r in quality_rules.keep_good(docs, labels).collect()} == kept
    assert quality_rules.keep_good(docs, labels).schema == docs.schema


def test_no_labels_keep_what_passes_base_rules(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in quality_rules.quality_verdicts(documents(spark), labels).collect():
        assert r.kept == (not r.base_failed)
    assert quality_rules.quality_verdicts(documents(spark, []), labels).count() == 0


# --- line dedup -------------------------------------------------------------------


@pytest.mark.parametrize("rows", [texts(), []])
def test_line_dedup(spark, rows):
    key = lambda line: ascii_lower(line.strip(SPACE))
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc_id)
    want = Counter()
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        lost = lambda line: (
            len(k := key(line)) >= 40 and len(holders[k]) >= 5 and doc_id != max(i for i in holders[k] if i is not None)
        )
        kept = [x for x in lines if not lost(x)]
        want[doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    docs = documents(spark, rows)
    out = line_dedup.dedup_lines(docs)
    assert out.select("doc.*").schema == docs.schema
    assert Counter((r.doc.doc_id, r.n_lines, r.n_dropped, r.doc.text or "") for r in out.collect()) == want


# --- secrets ----------------------------------------------------------------------


def test_secret_base_spans(spark):
    rng = random.Random(4)
    parts = ["PassWord", "api_key", "apikey", '"', "'", " ", ":", "=", "abc123", "AKIA", "ABCDEFGH12345678", "deadbeef", "0" * 24, "g", "\n", "é", "ſecret", "token"]
    rows = [*texts(), *((1000 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(400))]
    assign = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got = {r.doc_id: r for r in secret_scans.secret_spans(documents(spark, [x for x in rows if x[0] is not None])).collect()}
    for doc_id, text in rows:
        if doc_id is None:
            continue
        text = text or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        base = [(s.start, secret_scans.KINDS.index(s.kind), s.end) for s in got[doc_id].base]
        assert base == sorted(want)
        assert set(base) <= {(s.start, secret_scans.KINDS.index(s.kind), s.end) for s in got[doc_id].spans}


def test_constants_reach_sensitive_names():
    text = 'k = "Zx81-kk20-vv"\nclient_secret_value: k\ncolour = "Zx81-kk20-ww"'
    assert [text[s:e] for s, _, e in secret_scans.scan(text)[1]] == ["Zx81-kk20-vv"]
    assert secret_scans.mask(text, secret_scans.scan(text)[1]).startswith('k = "[SECRET]"')
    assert secret_scans.scan("the token of thanks: a word; pass: no")[1] == []


@pytest.mark.parametrize("name", [n for n, weight in secret_scans.SENSITIVE.items() if weight >= 0.7])
@pytest.mark.parametrize("value", ["tulip canyon 7 orbit 93", "quiet maple lantern harbor", "qWzXkVbNmPlTrGhJsDfYcEuA"])
def test_passphrases_and_letters_of_each_name(name, value):
    text = f'colour = "{value}"\n{name} = "{value}"\n'
    found = [(s, text[s:e]) for s, _, e in secret_scans.scan(text)[1]]
    if " " in value and secret_scans.SENSITIVE[name] < 0.9:
        assert found == []
    else:
        assert any(value in part and s > len(value) for s, part in found) and all(s > len(value) for s, _ in found)


def test_masking_keeps_rows_and_columns(spark):
    docs = documents(spark)
    out = secret_scans.mask_secrets(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    masked = {r.doc_id: r.text for r in out.collect()}
    assert "hunter2" not in masked[40] and masked[5] == "a b c d e f"


# --- packing ----------------------------------------------------------------------


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = random.Random(6)
    for _ in range(40):
        histogram = {x: rng.randint(1, 9) for x in rng.sample(range(1, 30), rng.randint(1, 8))}
        lengths, k = sorted(histogram), rng.randint(1, 4)
        cost = lambda ends: sum(c * min(e for e in ends if e >= x) for x, c in histogram.items())
        best = min(cost((*s, lengths[-1])) for n in range(k) for s in combinations(lengths[:-1], min(n, len(lengths) - 1)))
        ends = packing.boundaries(histogram, k)
        assert len(ends) <= k and cost(ends) == best
    assert packing.boundaries({}) == []


def test_packing(spark):
    rows = packing.pack(documents(spark), max_len=100, buckets=3, budget=300).collect()
    totals = Counter()
    for r in rows:
        totals[r.doc_id] += r.n_tokens
    want = Counter()
    for i, t in texts():
        want[i] += len(re.findall(r"[A-Za-z]+|[^\x00-\x7f]+|[!-~]", t or ""))
    assert totals == want
    placed = [r for r in rows if r.n_tokens]
    assert all(r.bucket_len is None and r.batch is None for r in rows if not r.n_tokens)
    assert all(r.n_tokens <= r.bucket_len for r in placed)
    slots = Counter((r.bucket_len, r.batch, r.slot) for r in placed)
    assert max(slots.values()) == 1
    for length in {r.bucket_len for r in placed}:
        ranks = sorted(b * max(1, 300 // length) + s for x, b, s in slots if x == length)
        assert ranks == list(range(len(ranks)))
    assert packing.pack(documents(spark, [])).count() == 0


# --- personal data ----------------------------------------------------------------


def luhn(number):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def personal(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        number = re.sub("[^0-9]", "", m[0])
        if 12 <= len(number) <= 19 and luhn(number):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_personal_base_spans(spark):
    rng = random.Random(5)
    parts = ["1", "55", "255", "256", "00", ".", " ", "-", "+", "(", ")", "a", "@", "x.y", "%", "é", "\n", "4111111111111111", "a@b.c", "37828224 6310005"]
    rows = [x for x in texts() if x[0] is not None]
    rows += [(1000 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(600)]
    rows += [(2000, "1" * 50_000), (2001, "1 2 " * 20_000), (2002, "a" * 100_000), (2003, "x@y.z" * 3000)]
    for r in pii_context.personal_spans(documents(spark, rows)).collect():
        assert span_list(r.base) == personal(dict(rows)[r.doc_id] or "") and set(span_list(r.base)) <= set(span_list(r.spans))


def test_personal_counts_are_those_of_each_kind(spark, tmp_path):
    rows = [(1, "on 10.0.0.1 and 10.0.0.2"), (2, "a@b.cd x@y.zz 4111 1111 1111 1111"), (3, "call +1 (555) 010-7788"), (4, None)]
    found = pii_context.op8_pii_context(spark, folder(spark, tmp_path, documents=documents(spark, rows))).collect()
    counts = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in found}
    assert counts == {1: (0, 2, 0, 0), 2: (2, 0, 1, 0), 3: (0, 0, 0, 1), 4: (0, 0, 0, 0)}


def test_contexts_discover_identifiers(spark):
    known = ["a@b.co", "c9@d.org", "x@y.zz", "+1 (555) 555-1234", "k@l.mn", "q@w.er", "u@i.op"]
    rows = [(i, f"please reach badge no {x} ok") for i, x in enumerate([*known, "BX-99887", "BX-99887."])] + [(99, "in year 20240 there was")]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii_context.personal_spans(documents(spark, rows)).collect()}
    assert got[7] == got[8] == [(4, 22, 30)] and got[99] == []
    assert pii_context.personal_spans(documents(spark, [])).count() == 0


# --- languages ---------------------------------------------------------------------


def test_languages_of_held_out_documents(spark):
    rng = random.Random(8)
    stems = {"aa": "kolu mira tesa", "bb": "schtz wurg brenk", "cc": "ção ñandu éité"}
    rows = [(i, " ".join(rng.choice(stems[x].split()) + rng.choice("abc") for _ in range(40)), x) for i in range(240) for x in [list(stems)[i % 3]]]
    rows += [(900, None, "aa"), (901, "12 !!", "bb"), (None, "kolu mira", "aa"), (902, "kolu mira tesa", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS lang_pred", "1 AS gram")
    got = {r.doc_id: r for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == got[None].lang_pred == "aa"
    held = [i for i in range(240) if got[i].held_out]
    assert held and all(got[i].lang_pred == rows[i][2] for i in held)
    empty = language_id.fit(docs.limit(0))
    assert language_id.predict(docs.limit(3), empty).filter("lang_pred <> 'und'").isEmpty()


def test_more_languages_than_a_word_holds(spark):
    letters = "abcdefghijklmnopqrst"
    rng = random.Random(12)
    names = [f"l{i:02}" for i in range(70)]
    stems = {x: ["".join(rng.choice(letters) for _ in range(6)) for _ in range(12)] for x in names}
    rows = [(i, " ".join(rng.choice(stems[x]) for _ in range(30)), x) for i in range(840) for x in [names[i % 70]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.languages == names and model.masks.shape == (3, language_id.SLOTS)
    held = [r for r in language_id.predict(docs, model).collect() if r.held_out]
    assert {rows[r.doc_id][2] for r in held} >= {"l00", "l31", "l32", "l63", "l64", "l69"}
    assert all(r.lang_pred == rows[r.doc_id][2] for r in held)


def test_numbers_are_no_letters_for_language_id():
    # Fractions, superscripts, Roman numerals and non-Latin digits are numbers, not letters.
    for text in ["½ ² Ⅷ ٣ 42", "³/₄ ⅓", "٠١٢ ۴۵"]:
        assert language_id.normal(text).strip() == ""
    assert language_id.normal("Wörld ½x") == " wörld x "


def test_batches_become_python_values_in_bounded_parts():
    import pyarrow as pa

    from adpace.llm import common

    texts = ["", None, "x" * (3 * common.PART), *["y" * 1000] * 20_000, "z"]
    batch = pa.RecordBatch.from_pydict({"i": list(range(len(texts))), "text": texts, "ids": [[n, n] for n in range(len(texts))]})
    parts = list(common._parts(batch))
    assert all(p.nbytes <= common.PART or p.num_rows == 1 for p in parts) and len(parts) > 4
    for name in ("i", "text", "ids"):
        whole = common._values(batch.column(batch.schema.get_field_index(name)))
        assert [x for p in parts for x in common._values(p.column(p.schema.get_field_index(name)))] == whole
