"""Rules, secrets and counts against plain loops; empty tables, missing values, repeated rows, clashing columns."""

import hashlib
import re

import pytest

from doctables.llm import line_rules, packing, secrets, spaced_seeds, transducer, wavelet
from doctables.llm.tokens import Encoder, tokenizer_path
from doctables.sinks.stored import shared_folder
from tests.llm.rows import SCHEMA, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def table(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def plain_measures(text):
    words = WORD.findall(text)
    seen = {}
    for k in range(len(words) - 7):
        seen.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {j for at in seen.values() if len(at) > 1 for k in at for j in range(k, k + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    data = rows(1) + [(900, "one two three four five six seven eight nine " * 6, "en", "s", 1, "", 1, 1, "", "")]
    got = {r.doc_id: r for r in line_rules.verdicts(table(spark, data)).collect()}
    assert len(got) == len(data)
    for i, text, *_ in data:
        r, want = got[i], plain_measures(text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, text
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)


def test_lines_of_many_documents(spark):
    spelled = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    prose = lambda k: " ".join(f"w{spelled(k)}x{spelled(j)}" for j in range(24))
    licence = "All Rights " + " ".join(f"reserved{chr(97 + j)}" for j in range(22)) + " 2024"
    data = [(k, f"{prose(k)}\n{licence}", "en", "s0", 0) for k in range(8)]
    data += [(100 + k, licence + f"\nshort {chr(97 + k)}", "en", "s0", 0) for k in range(3)]  # little is left of these
    data += [(200, f"{prose(200)}\n{licence}", "en", "s1", 0)]  # few documents of this host
    data += [(300 + k, "\n".join(prose(300 + j) for j in range(20)) + f"\nlast {chr(97 + k)}", "en", "s0", 0) for k in range(9)]  # little is left of these either: they differ, so each counts
    data += [(400 + k, "\n".join(prose(400 + j) for j in range(20)), "en", "s0", 0) for k in range(9)]  # exact copies count once
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in line_rules.verdicts(docs, max_docs=5).collect()}
    gone = {100, 101, 102, *range(300, 309)}
    assert {i for i in got if not got[i].kept} == gone
    assert all(got[k].n_removed_words == 25 for k in range(8)) and got[200].n_removed_words == 0 and got[300].n_removed_words == 480 and got[400].n_removed_words == 0
    clean = {r.doc_id: r.text for r in line_rules.cleaned(docs, max_docs=5).collect()}
    assert set(clean) == set(got) - gone
    assert clean[3] == prose(3) and clean[200].endswith(licence) and clean[400] == data[21][1]


def test_menus_of_pages_that_are_alike_are_removed(spark):
    """Pages whose shared lines make them near copies of each other are different documents all the same."""
    spelled = lambda *n: " ".join(f"{chr(97 + j)}{''.join(chr(97 + int(c)) for c in '-'.join(map(str, n)) if c != '-')}" for j in range(9))
    menu = [f"menu {spelled(k)}" for k in range(26)]
    texts = ["\n".join([*menu, f"own {spelled(1000 + k)}"]) for k in range(60)]
    docs = spark.createDataFrame([(k, t, "en", "s0", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = line_rules.verdicts(docs).collect()
    assert all(r.n_removed_words == 260 and not r.kept for r in got)


def test_columns_of_the_operators_own_names_do_not_clash(spark):
    data = [(k, f"w{k} password = 'hunter2hunter2' " + " ".join(f"v{k}x{j}" for j in range(30)), "s0", *["own"] * 10) for k in range(4)]
    names = ["_doc", "_tie", "_removed", "_blob", "_spans", "_gone", "doc", "tie", "removed", "kept"]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    item = spark.createDataFrame([(1, " ".join(f"v2x{j}" for j in range(30)))], "item_id long, text string")
    lines, seeds, safe = line_rules.cleaned(docs), spaced_seeds.clean(docs, item), secrets.redacted(docs, shared_folder(spark))
    for out, n in ((lines, 4), (seeds, 3), (safe, 4)):
        rows = out.collect()
        assert out.columns == docs.columns and len(rows) == n and all(r[name] == "own" for r in rows for name in names)
    assert all("[secret]" in r.text and "hunter2" not in r.text for r in safe.collect())


@pytest.mark.parametrize(("shared", "own"), [(10, 1), (10, 2), (30, 3), (2, 5)])
def test_shared_lines_do_not_shield_each_other(spark, shared, own):
    spelled = lambda *n: " ".join(f"{chr(97 + j)}{''.join(chr(97 + int(c)) for c in '-'.join(map(str, n)) if c != '-')}" for j in range(9))
    menu = [f"menu {spelled(k)}" for k in range(shared)]
    texts = ["\n".join([*menu, *(f"own{'x' * j} {spelled(1000 * (j + 1) + k)}" for j in range(own))]) for k in range(60)]
    docs = spark.createDataFrame([(k, t, "en", "s0", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = {line_rules.line_hash("s0", x) for x in menu}
    assert all(set(r.removed) == want for r in line_rules.verdicts(docs).collect())
    # exact copies count once: twenty distinct documents, however often each is repeated, are not above twenty
    few = docs.filter("doc_id < 20").crossJoin(spark.range(3).select()).repartition(3)
    assert all(not r.removed for r in line_rules.verdicts(few).collect())


def plain_spans(text):
    found = []
    for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets(spark):
    data = rows(2) + [(900 + k, t, "en", "s", 1, "", 1, 1, "", "") for k, t in enumerate(["AKIA" * 9, "token==abcdef" * 3, "SECRET : aaaaaa" + "f" * 30, "-----BEGIN RSA PRIVATE KEY-----", "gho_" + "a1" * 20])]
    folder = shared_folder(spark)
    docs = table(spark, data)
    first = {r.doc_id: r for r in secrets.report(secrets.scan(docs, folder)).collect()}
    assert len(first) == len(data)
    for i, text, *_ in data:
        want = plain_spans(text or "")
        shown = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert first[i].base_sha256 == hashlib.sha256(shown.encode()).hexdigest(), (text, first[i].spans, shown)
        assert (first[i].n_assign, first[i].n_access, first[i].n_hex) == tuple(sum(x[2] == k for x in want) for k in ("assign", "access", "hex"))
        assert set(filter(None, shown.split(","))) <= set(first[i].spans.split(","))
    size = spark.read.parquet(folder).count()
    assert size == len({t or "" for _, t, *_ in data})
    more = docs.union(spark.createDataFrame([(5000, "a new secret: abcdefgh", "en", "s", 1, "", 1, 1, "", "")], SCHEMA))
    again = secrets.report(secrets.scan(more, folder))
    assert again.count() == len(data) + 1 and spark.read.parquet(folder).count() == size + 1
    assert secrets.report(secrets.scan(more, folder)).count() == len(data) + 1 and spark.read.parquet(folder).count() == size + 1
    marked = {r.doc_id: r.text for r in secrets.redacted(docs, shared_folder(spark)).collect()}
    assert all((marked[i] == t) == (not first[i].spans) for i, t, *_ in data)
    assert marked[900] == "[secret]" and marked[903] == "[secret]"


@pytest.mark.parametrize("chunk", [4, 64, 1 << 18])
def test_token_counts(spark, chunk):
    data = rows(3, 12)
    encode = Encoder(BYTE).whole
    got = {r.doc_id: r for r in transducer.token_counts(table(spark, data), BYTE, chunk_bytes=chunk, limit=50).collect()}
    assert len(got) == len(data)
    for i, text, *_ in data:
        n = len(encode(text or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 50), text


def test_every_character_is_cut_as_the_library_does():
    import pyarrow as pa

    encode = Encoder(BYTE)
    points = [c for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000] + list(range(0x10000, 0x10100))
    texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in points[k : k + 50]) for k in range(0, len(points), 50)]
    ids, counts = encode.slice(pa.array(texts))
    at = 0
    for text, n in zip(texts, counts):
        assert ids[at : at + n].tolist() == encode.whole(text).tolist(), [hex(ord(c)) for c in text[::6]]
        at += n


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_ids_are_those_of_the_library(path):
    import pyarrow as pa

    encode, texts = Encoder(path), [r[1] for r in rows(4)]
    ids, counts = encode.slice(pa.array(texts))
    assert ids.tolist() == [x for t in texts for x in encode.whole(t or "")] and counts.tolist() == [len(encode.whole(t or "")) for t in texts]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert wavelet.digests(wavelet.wavelet_files(none, BYTE)).count() == 0
    assert line_rules.verdicts(none).count() == 0 and line_rules.cleaned(none).count() == 0
    assert packing.packed(none, WORDS).count() == 0
    assert secrets.report(secrets.scan(none, shared_folder(spark))).count() == 0
    assert transducer.token_counts(none, BYTE).count() == 0


def test_missing_and_repeated_rows(spark):
    twice = [(None, "a b", None, None, None, None, None, None, None, None)] * 3 + [(5, None, None, None, None, None, None, None, None, None)] * 2
    docs = spark.createDataFrame(twice, SCHEMA)
    assert wavelet.digests(wavelet.wavelet_files(docs, BYTE)).count() == 5
    assert line_rules.verdicts(docs).count() == 5
    assert packing.packed(docs, WORDS).count() >= 5
    assert secrets.report(secrets.scan(docs, shared_folder(spark))).count() == 5
    assert transducer.token_counts(docs, BYTE).count() == 5
