"""Tokenising, counting, formatting, language, quality."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylake.llm import bpe, chat_template, doc_fingerprint, exact_dedup, langid, near_copies, quality, queries, simhash, token_scan

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


@pytest.mark.parametrize("which", ["small", "awkward"])
def test_bpe_equals_the_library(request, library, which):
    df, rows = request.getfixturevalue(which)
    got = sorted(bpe.round_trip(df, queries.tokenizer_path()).collect(), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_large_ids_beside_a_null_one(make):
    big = (1 << 60) + 1
    df = make([(None, "a b c"), (big, "a b d")])
    path = queries.tokenizer_path()
    for found in (bpe.round_trip(df, path), token_scan.document_token_counts(df, path), langid.identify(df, F.lit(True)), queries.pack_documents(df)):
        assert {r["doc_id"] for r in found.collect()} == {None, big}


def test_bpe_random_texts(library):
    rng = np.random.default_rng(3)
    enc = bpe.encoder(queries.tokenizer_path())
    signs = list("aZé '\"?!.\n\t19_sltdrevm中<|>😀​\xa0\x1c")
    for n in range(1500):
        text = "".join(rng.choice(signs, rng.integers(0, 120)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert enc.encode(text) == ids
        library.encode_special_tokens = True
        assert list(enc.count_batch([text, None])) == [len(library.encode(text, add_special_tokens=False).ids), 0]
        library.encode_special_tokens = False
        assert enc.decode(ids[n % 3 :]) == library.decode(ids[n % 3 :], skip_special_tokens=False)


def test_bpe_encode_decode_tables(awkward):
    df, rows = awkward
    ids = bpe.encode_documents(df, queries.tokenizer_path())
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(ids, queries.tokenizer_path()).collect()}
    assert back == {i: t or "" for i, t in rows}


@pytest.mark.parametrize("block", [8, 64, 4096])
def test_token_counts(awkward, library, block):
    df, rows = awkward
    library.encode_special_tokens = True
    want = sorted((str(i), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    library.encode_special_tokens = False
    if block == 8:
        df, want = df.filter("length(text) < 200 or text is null"), [(i, n) for i, n in want if i not in ("11", "12")]
    got = token_scan.document_token_counts(df, queries.tokenizer_path(), block_bytes=block)
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got.collect()) == want


@pytest.mark.parametrize("range_bytes", [1, 200, 1 << 20])
def test_scan_of_flat_files(spark, tmp_path, range_bytes):
    rng = np.random.default_rng(5)
    want = {}
    for name, n, sizes in (("a", 700, 40), ("b", 1, 3000), ("c", 50, 1), ("d", 0, 0)):
        lengths = rng.integers(0, sizes + 1, n)
        flat = [t for k in lengths for t in [*rng.integers(0, 9, k), 50_256]]
        np.array([*flat, 1, 2], "<u2").tofile(tmp_path / f"{name}.bin")
        want[name] = lengths.tolist()
    blocks = token_scan.read_token_files(spark, str(tmp_path), 64, range_bytes)
    rows = token_scan.scan(blocks, 50_256, width=2, chunk=3).orderBy("file", "block_no").collect()
    got = {}
    for r in rows:
        mine = got.setdefault(r["file"][-5], [])
        assert r["first_ordinal"] == len(mine)
        mine += r["lengths"]
    assert got == want


def test_template_language():
    t = lambda src, **env: "".join(p for p, _ in chat_template.generate(chat_template.fold(chat_template.Parser(src).parse()))(env, False))
    assert t("a{{ 'b' ~ 1 | upper }}c") == "ab1c"
    assert t("{% if x == 'q' and not y %}1{% else %}2{% endif %}", x="q", y=None) == "1"
    assert t("{% for a in xs %}[{{ a.k | trim }}{{ a.none }}]{% endfor %}", xs=[{"k": " v "}, {}]) == "[v][]"
    folded = chat_template.fold(chat_template.Parser("x{{ 'y' | upper }}{% if 'a' == 'a' %}z{% else %}w{% endif %}").parse())
    assert [(p.kind, p.value) for p in folded.parts] == [("text", "xYz")]
    for bad in ("{% for x %}{% endfor %}", "{{ a.b() }}", "{{ a | eval }}", "{% import os %}", "{% if a %}", "{{ __import__('os') }}"):
        with pytest.raises(chat_template.TemplateError):
            chat_template.compile_template(bad)
    assert t("{{ x.__class__ }}", x="s") == ""


def test_template_round_trip():
    rng = np.random.default_rng(7)
    bits = ["\\", "### ", "###", " </turn>\n", "</turn>", ": ", "assistant", "\n", "x", "é", "\\###"]
    for _ in range(300):
        turns = [{"role": rng.choice(["user", "assistant", "a: b", "", "### x"]), "text": "".join(rng.choice(bits, rng.integers(0, 9)))} for _ in range(rng.integers(0, 6))]
        render = chat_template.compile_template()
        back = list(chat_template.read_back(render(turns)))
        assert [(r, t) for r, t, _, _ in back] == [(str(x["role"]), x["text"]) for x in turns]
        assert [m for _, _, m, _ in back] == [x["text"] if x["role"] == "assistant" else "" for x in turns]
        text, spans = chat_template.render_text(turns)
        assert sum(n for *_, n in back) == len(text)
        assert [chat_template.unescape(text[s:e]) for s, e in spans] == [x["text"] for x in turns if x["role"] == "assistant" and x["text"]]


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "assistant", "### yes"), (None, 0, "user", "x"), (2, None, None, None), (2, 1, "system", ""), (1, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat_template.format_conversations(df).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 4, None: 1, 2: 2}
    assert got[1]["turns_sha256"] == sha("user\nhi\nuser\nhi\nassistant\n\nassistant\n### yes\n")
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (7, sha("### yes"))
    assert chat_template.format_conversations(df.limit(0)).count() == 0
    texts = {r["conv_id"]: r["formatted"] for r in chat_template.format_tables(df.filter("conv_id = 1")).collect()}
    assert len(texts[1]) == got[1]["formatted_chars"]


def plain_ppm(samples, order, contexts, seen):
    """Code lengths by the definition: counts of all strings, escapes by method C, the longest context of the chosen set."""
    langs = sorted(samples)
    counts = {lang: [Counter(b[i : i + k + 1] for t in samples[lang] for b in [t.encode()] for i in range(len(b) - k)) for k in range(order + 1)] for lang in langs}
    totals = Counter()
    for lang in langs:
        for level in counts[lang][1:]:
            for gram, n in level.items():
                totals[gram[:-1]] += n
    chosen = {b""}
    for context, n in sorted(totals.items(), key=lambda x: (-x[1], len(x[0]), x[0])):
        if len(chosen) >= contexts or n < seen:
            break
        if context[1:] in chosen and context[:-1] in chosen:
            chosen.add(context)

    def chance(lang, context, byte):
        after = {g[-1]: n for g, n in counts[lang][len(context)].items() if g[:-1] == context}
        total, kinds = sum(after.values()), len(after)
        if byte in after:
            return after[byte] / (total + kinds)
        return (kinds / (total + kinds) if total else 1.0) * (chance(lang, context[1:], byte) if context else 1 / 256)

    def lengths(text):
        out = np.zeros(len(langs))
        for i in range(len(text)):
            context = next(text[j:i] for j in range(max(0, i - order), i + 1) if text[j:i] in chosen)
            out += [-np.log2(chance(lang, context, text[i])) for lang in langs]
        return out

    return lengths


@pytest.mark.parametrize(("order", "contexts", "seen"), [(3, 500, 1), (4, 30, 2), (2, 8, 1)])
def test_ppm_equals_brute_force(order, contexts, seen):
    samples = {"x": ["abracadabra abra ", "abra kadabra é"], "y": ["hello world, hello there", "yes", ""], "z": ["日本語 abra"]}
    model, plain = langid.fit(samples, order, contexts, seen), plain_ppm(samples, order, contexts, seen)
    texts = [b"abra world", b"", b"hello " * 120 + b"zz", bytes(range(60)), "日本 é".encode()]
    for text, got in zip(texts, model.code_lengths(texts), strict=True):
        assert np.allclose(got, plain(text), rtol=1e-5)


def test_every_language_is_learned(spark):
    rows = [(i * 100 + k, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 20, f"l{i:02d}") for i in range(80) for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, F.lit(True)).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_language_sample_of_repeated_ids_and_clashing_columns(spark):
    long = "der hund und die katze " * 40_000
    rows = [(None, "the cat and the dog", "en", "x")] * 900 + [(1, long, "de", "y"), (2, "der hund und die katze", "de", "z")] + [(3, "the dog", None, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _text string").withColumn("score", F.lit("clash"))
    sample = langid.training_sample(df, F.lit(True), "doc_id", "text", "lang", 400)
    assert {k: len(v) for k, v in sample.items()} == {"en": 400, "de": 2}
    found = langid.identify(df.drop("_text"), F.lit(True)).collect()
    assert len(found) == len(rows) and {r["lang_pred"] for r in found if r["doc_id"] in (1, 2)} == {"de"}


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = queries.op6_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(truth) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97


def plain_network(model, text):
    """The classifier's score step by step, word by word."""
    ids = [model.vocabulary.get(w, model.vocabulary.get(quality.shape(w), 0)) for w in text.split()]
    mean = sum((model.vectors[i].astype(float) for i in ids), np.zeros(model.vectors.shape[1])) / max(1, len(ids))
    half = len(mean) // 2
    again = sum(a == b for a, b in zip(ids, ids[1:])) / (len(ids) - 1) if len(ids) > 1 else 0.0
    x = [*mean, math.log1p(len(ids)), math.log(1e-3 + math.dist(mean[:half], [0] * half)), math.log(1e-3 + math.dist(mean[half:], [0] * half)), len(set(ids)) / max(1, len(ids)), again]
    w1, b1, w2, b2 = model.layers
    x = [(v - m) / s for v, m, s in zip(x, model.mean, model.spread)]
    hidden = [math.tanh(sum(v * w1[i][h] for i, v in enumerate(x)) + b1[h]) for h in range(len(b1))]
    return 1 / (1 + math.exp(-max(-35, min(35, (sum(v * w for v, w in zip(hidden, w2)) + b2) / model.temperature))))


def test_network_equals_brute_force():
    rng = np.random.default_rng(3)
    good, bad = ["alpha", "beta", "gamma", "delta"], ["ZZZ", "$$$", "111", "buy"]
    texts = [" ".join(rng.choice(good if k % 2 else bad, 30)) for k in range(120)]
    model = quality.fit(texts, [k % 2 for k in range(120)])
    asked = ["alpha beta beta Newword 42", "", "buy buy buy", "delta " * 40_000, "§"]
    assert np.allclose(model.scores(asked), [plain_network(model, t) for t in asked], atol=1e-6)
    assert model.scores(texts)[1] > 0.5 > model.scores(texts)[0]


def test_language_edge_cases(make):
    rows = [(0, "the cat sat on the mat " * 9), (1, "der hund und die katze " * 9), (2, None), (3, "123 !?"), (None, "the the"), (4, "der und die"), (4, "der und die"), (5, "")]
    df = make(rows, ["en", "de", "en", "de", None, None, None, None])
    got = sorted(((r["doc_id"], r["lang_pred"]) for r in langid.identify(df, F.lit(True)).collect()), key=str)
    assert got == sorted([(0, "en"), (1, "de"), (2, "und"), (3, "und"), (None, "en"), (4, "de"), (4, "de"), (5, "und")], key=str)
    assert langid.identify(df.limit(0), F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df, F.lit(False)).collect()} == {"und"}


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.op9_quality(spark, sf).collect()]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.97, auc


def test_quality_edge_cases(spark, make):
    df = make([(0, "a fine sentence"), (1, None), (None, "x"), (2, ""), (2, "")])
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, None), (9, 1), (2, 7)], "doc_id long, quality int")
    got = quality.classify(df, labels, F.lit(True)).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.classify(df, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert quality.classify(df.limit(0), labels, F.lit(True)).count() == 0


def test_internal_names_as_columns_of_the_input(spark, make):
    """Columns called like internal ones neither break an operator nor get into its result."""
    rows = [(1, "the quick brown fox jumps"), (2, "the quick brown fox jumps"), (3, "something else entirely here"), (None, None)]
    df = make(rows)
    for name in ("fp", "key", "part", "batch", "kind", "shard", "_text", "cluster", "size", "node", "root", "h", "t", "l", "n", "low"):
        df = df.withColumn(name, F.lit("clash"))
    plain = make(rows)
    asked = {
        "bpe": lambda d: bpe.round_trip(d, queries.tokenizer_path()), "simhash": simhash.near_duplicates, "exact": exact_dedup.exact_dedup, "language": lambda d: langid.identify(d, F.lit(True)),
        "fingerprint": doc_fingerprint.edit_sensitivity, "pack": queries.pack_documents, "near": lambda d: near_copies.near_copies(d).drop("root"),
    }
    for name, run in asked.items():
        shown = [sorted(map(str, run(d).collect())) for d in (df, plain)]
        assert shown[0] == shown[1] and "clash" not in "".join(shown[0]), name
    assert sorted(r["doc_id"] or 0 for r in exact_dedup.keep_first_copies(df).collect()) == [0, 2, 3]


def test_very_long_turns(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", "word ### </turn> " * 60_000) for k in range(3)]
    got = chat_template.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert (got["n_turns"], got["loss_chars"]) == (3, len(rows[1][3])) and got["loss_sha256"] == sha(rows[1][3])


def test_templates_that_look_beyond_a_turn(spark):
    """They stream a conversation through one task and give what rendering it at once gives."""
    other = "{% for m in messages %}" + "{{ '###' ~ ' ' }}{{ m.role | escape_role }}: {% if first %}{{ '' }}{% endif %}{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}{{ ' </turn>' ~ '\\n' }}{% endfor %}"
    assert chat_template.separable() and not chat_template.separable(other) and not chat_template.separable("{{ messages }}")
    df = spark.createDataFrame([(c, k, "assistant" if k % 2 else "user", f"text {k} ###") for c in (1, 2) for k in range(5)], "conv_id long, turn long, role string, text string")
    want, got = (sorted(map(str, chat_template.format_conversations(df, t).collect())) for t in (chat_template.TEMPLATE, other))
    assert want == got


@pytest.mark.parametrize("text", ["日本語テキスト の　文章 です 123", "Это русский текст — с «кавычками»", "نص عربي قصير", "naïve café\u00a0x\u2003y\u3000z", "é" * 5000 + " 字" * 3000, "中文's test'll"])
def test_forced_cuts_beyond_ascii(library, text):
    encoder = bpe.encoder(queries.tokenizer_path())
    assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert b"".join(encoder.fragments(text.encode())) == text.encode()


def test_remembered_fragments_are_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 2000)
    encoder = bpe.ByteBPE(queries.tokenizer_path())
    texts = [f"word{k} other{k * 7} " + "x" * (k % 400) for k in range(300)]
    monkeypatch.setattr(bpe, "TOGETHER", 200)
    got = [[i for part in parts for i in part] for parts in encoder.encode_batch(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(encoder.count_batch(texts)) == list(map(len, got)) and encoder.held < 40_000


def test_counts_of_texts_counted_together(library, monkeypatch):
    """Fragments of up to seven bytes are keyed by their bytes: zero bytes, lengths about seven and neighbouring texts keep apart."""
    path = queries.tokenizer_path()
    library.encode_special_tokens = True
    texts = [None, "", "a", "\0", "\0\0", "a\0", "abcdefg", "abcdefgh", "abcdef", " abcdef", " abcdefg", "", "é" * 3, "é" * 4, "日本語", "x" * 300, " " * 9, "'", "s", "'s", None, "<|endoftext|>"] * 3
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    library.encode_special_tokens = False
    for together in (1, 30, 1 << 21):
        monkeypatch.setattr(bpe, "TOGETHER", together)
        encoder = bpe.ByteBPE(path)
        assert list(encoder.count_batch(texts)) == list(encoder.count_batch(texts)) == want
