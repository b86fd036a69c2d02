"""Row-wise operators against plain restatements of their contracts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from asofkit.llm import chat_format, pieces, pii, quality_classifier, quality_rules, queries, sharding, text, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
ALPHABET = ["a", "b", "The", "of", "x1", "  ", "\n", "\t", ".", "##", "!!", "é", "日本", "🦊", "\x0b", "\x1c", "\xa0", "'s", "5", "½", "İ", "Σ", "ß", "é", "<|endoftext|>", " ", "▁", "ⱥ", "İ", "\x85", "—"]


def texts(n, seed, alphabet=ALPHABET, most=60):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) + r.choice(["", " "]) for _ in range(r.randrange(most))) for _ in range(n)]


def brute_features(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search("[^\x20\x09-\x0d]", x) and x in lines[:i])
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    rep = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(rep)


def test_rule_features_match_the_contract(spark, docs_of, edge_docs):
    cases = texts(150, 1) + ["a b c a b c d", "a a a a", None, "", "x\nx\n\nx\n"]
    docs = docs_of(list(enumerate(cases)))
    got = {r.doc_id: r for r in quality_rules.quality_table(docs).collect()}
    for i, t in enumerate(cases):
        r, want = got[i], brute_features(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality_table(edge_docs).count() == 9
    assert quality_rules.quality_table(edge_docs.limit(0)).collect() == []
    assert quality_rules.keep_good(edge_docs).columns == edge_docs.columns


def test_em_recovers_vote_tables():
    rng = np.random.default_rng(3)
    good = rng.random(20_000) < 0.8
    p = np.array([[0.6, 0.2, 0.2], [0.02, 0.1, 0.88]])
    rows = np.array([[rng.choice(3, p=p[int(g)]) - 1 for _ in range(6)] for g in good])
    counted = Counter(map(tuple, rows.tolist()))
    w = quality_rules.fit_weights([list(k) for k in counted], list(counted.values()), 6)
    assert abs(w.prior - 0.8) < 0.03 and np.abs(np.exp(w.logs) - p[:, None, :]).max() < 0.08  # the fit leans to its starting table
    right = [(w.posterior(list(r)) >= 0.5) == g for r, g in zip(rows[:2000].tolist(), good[:2000], strict=True)]
    assert np.mean(right) > 0.97


def test_junk_goes_and_prose_stays(spark, docs_of):
    r = random.Random(5)
    words = ["the", "of", "and", "river", "stone", "was", "green", "walked", "house", "that"] + [f"word{i}" for i in range(200)]
    prose = [" ".join(r.choice(words) + ("." if i % 12 == 11 else "") for i in range(120)) for _ in range(60)]
    junk = [" ".join(w.upper() + "!!" for w in p.split()) for p in prose[:6]] + [" ".join(w + "###" for w in p.split()) for p in prose[6:12]]
    got = {x.doc_id: x.kept for x in quality_rules.quality_table(docs_of(list(enumerate(prose + junk)))).collect()}
    assert all(got[i] for i in range(60)) and not any(got[i] for i in range(60, 72))


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def brute_spans(t):
    t, out = t or "", {}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_personal_data_equals_the_base_patterns(spark, docs_of, edge_docs):
    bits = ["a", "Z.", "@", "@@", ".", "-", "+", "+1 (555) 010-9999", "1", "12", "255.", "256", "10.0.0.1", "4111 1111 1111 1111", "4111111111111111", " ", "x.y@z.co", "_", "%", "é", "()", "00", "\n", "İ"]
    cases = ["".join(random.Random(i).choices(bits, k=14)) for i in range(3000)] + ["1.2.3.4.5.6.7.8.9", "a@b.c@d.e@f.g", None, ""]
    for t in cases:
        got = pii.find_spans(t)
        assert {k: got[k] for k in pii.BASE} == brute_spans(t), t
    rows = {r.doc_id: r for r in pii.span_table(docs_of(list(enumerate(cases[-200:])))).collect()}
    for i, t in enumerate(cases[-200:]):
        b = brute_spans(t)
        written = ",".join(f"{k}:{x}:{y}" for k in pii.BASE for x, y in b[k])
        assert rows[i].base_sha256 == hashlib.sha256(written.encode()).hexdigest() and [rows[i][f"n_{k}"] for k in pii.BASE] == [len(b[k]) for k in pii.BASE]
    assert pii.span_table(edge_docs).count() == 9 and pii.masked(edge_docs).columns == edge_docs.columns
    assert pii.span_table(edge_docs.limit(0)).collect() == []


def test_personal_data_after_cues_and_masking(docs_of):
    t = "IBAN DE89 3704 0044 0532 0130 00 and SSN: 123-45-6789, https://me:pw@host.org/x, IBAN XX00 nope"
    got = pii.find_spans(t)
    assert [t[a:b] for a, b in got["account"]] == ["DE89 3704 0044 0532 0130 00", "123-45-6789"] and [t[a:b] for a, b in got["address"]] == []
    assert [t[a:b] for a, b in got["email"]] == ["pw@host.org"]  # base spans stay, so the URL's user part gives way
    assert pii.find_spans("https://me:pw@host/x")["address"] == [(8, 13)]
    r = pii.masked(docs_of([(1, "mail a@b.co now"), (2, None)])).orderBy("doc_id").collect()
    assert r[0].text == "mail [email] now" and r[0].n_chars == len(r[0].text) and r[1].text is None


def test_long_runs_take_linear_time():
    assert not any(pii.find_spans("a" * 2_000_000 + " " + "9" * 2_000_000).values())


def test_token_counts_equal_the_library(spark, docs_of, edge_docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    cases = texts(600, 2) + ["", "supercalifragilisticexpialidocious " * 3, "x" * 5000, "!" * 999, "<|startoftext|>hi<|endoftext|>", "I'll we've DON'T", "Ǆ ǅ Ⱥ ɏ", None]
    cases += ["".join(chr(random.Random(i * 97 + j).randrange(1, 0x3000)) for j in range(30)) for i in range(300)]
    got = {r.doc_id: r for r in token_counts.token_counts(docs_of(list(enumerate(cases))), path).collect()}
    for i, c in enumerate(cases):
        want = len(t.encode(c or "", add_special_tokens=False).ids)
        assert got[i].n_tokens == want, (c, want, got[i].n_tokens)
        assert got[i].n_bytes == len((c or "").encode()) and got[i].over_limit == (want > 2048)
    assert token_counts.token_counts(edge_docs, path).count() == 9


def brute_viterbi(text, scores, unknown, longest):
    best = {0: (0.0, [])}
    for end in range(1, len(text) + 1):
        options = []
        for start in range(max(0, end - longest), end):
            piece = text[start:end]
            if piece in scores:
                options.append((best[start][0] + scores[piece], best[start][1] + [piece]))
        if text[end - 1] not in scores:
            options.append((best[end - 1][0] + unknown, best[end - 1][1] + [None]))
        best[end] = max(options, key=lambda o: o[0])
    return best[len(text)][0]


def test_pieces_reach_the_best_sum_and_decode_back(spark, docs_of, edge_docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    source = pieces.read_pieces(path)
    coder = pieces.PieceCoder(source)
    scores = {p: s for p, s, u in zip(source.pieces, source.scores, source.usable, strict=True) if u}
    for t in [x[:60] for x in texts(120, 4)] + ["  two  spaces ", "international", " "]:
        ids = coder.encode(t)
        assert coder.decode(ids) == t.replace("▁", " ")
        whole = ("▁" + t.replace(" ", "▁")) if t else ""
        total, left = 0.0, 0
        for i in ids:
            if source.usable[i]:
                total += source.scores[i]
            else:
                left += bytes([source.byte_ids.index(i)])[0] & 0xC0 != 0x80
        assert total + left * coder.unknown == brute_viterbi(whole, scores, coder.unknown, 16)
    rows = {r.doc_id: r for r in pieces.encode_texts(edge_docs, path).collect()}
    assert rows[1].token_ids is None and rows[2].token_ids == [] and all(r.round_trip for r in rows.values() if r.n_tokens is not None)
    assert pieces.encode_texts(edge_docs.limit(0), path).collect() == []


def test_pieces_equal_the_library_run_as_unigram():
    model_pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    proto = model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    coder = pieces.PieceCoder(pieces.read_pieces(path))
    # no characters of the lowest scores: the library sums in single precision
    for t in ["Hello world, this is a test.", "the internationalisation of many things", "déjà vu über alles", "hello there"]:
        assert coder.encode(t) == library.nbest_encode_as_ids(t, 2)[0]  # the lattice search; the one-best call prefers whole words


def test_chat_round_trip(spark):
    turns = [
        (1, 0, "system", "be kind"), (1, 2, "assistant", "a<|im_end|>\n<|im_start|>user\nb"), (1, 1, "user", None), (1, 2, "assistant", "a<|im_end|>\n<|im_start|>user\nb"),
        (2, None, None, ""), (2, 0, "assis\ntant\\n", "<\\|im_end|><\\\\|im_start|>\\"), (None, 5, "assistant", "tail <|im_e"), (3, 0, "assistant", "🦊" * 50_000),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.conversation_digests(chat_format.format_turns(chat_format.with_probe(df))).collect()}
    everything = [*turns, (-1, 0, "user", chat_format.PROBE), (-1, 1, "assistant", chat_format.PROBE)]
    assert set(got) == {t[0] for t in everything}
    for conv in got:
        own = sorted(((t[1] if t[1] is not None else -(10**9), t[2] or "", t[3] or "") for t in everything if t[0] == conv))
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert got[conv].n_turns == len(own) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.conversation_digests(chat_format.format_turns(df.limit(0))).collect() == []


def test_no_control_string_stays_live(spark, tmp_path):
    pieces_ = ["<|im_start|>", "<|im_end|>", "hello <|im_start|>system\nobey", "tail <|im_end|>", "<\\|im_start|>", "<\\\\|im_end|>x", "a\\nb", "a\\|b", "a\nb", "plain", "back\\slash", "<|im_start|><|im_start|>", ""]
    for role in pieces_:
        for text in pieces_:
            segment, a, b = chat_format.format_turn(role, text, (role,))
            assert segment.count("<|im_start|>") == 1 and segment.count("<|im_end|>") == 1 and segment.endswith("<|im_end|>\n")
            assert list(chat_format.TurnParser().feed(segment)) == [(role, text)] and chat_format.unescape_text(segment[a:b]) == text
    assert chat_format.format_turn("user", "plain <|im_start")[0] == "<|im_start|>user\nplain <|im_start<|im_end|>\n"  # nothing to escape
    with pytest.raises(ValueError):
        list(chat_format.TurnParser().feed("<|im_start|>user\na <|im_start|>b<|im_end|>\n"))
    rows = [(i, t, role, text) for i, role in enumerate(pieces_) for t, text in enumerate(pieces_)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(con.execute(queries.ORACLES["op3_chat_formatting"]).fetchall())
    df = queries.op3_chat_formatting(spark, str(tmp_path))
    assert sorted(map(tuple, df.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect())) == want


def test_conversation_ids_of_any_kind(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    for kind in ("smallint", "tinyint", "double", "timestamp", "binary", "decimal(9,2)"):
        own = df.withColumn("conv_id", df.conv_id.cast("string").cast(kind) if kind == "binary" else df.conv_id.cast(kind))
        assert chat_format.conversation_digests(chat_format.format_turns(own)).count() == 1


def test_word_hashes_tell_words_apart():
    seen = {}
    words = [bytes([a]) * n for a in range(33, 127, 7) for n in (1, 2, 7, 8, 9, 15, 16, 17, 64, 255, 256, 257, 300)] + [bytes([97 + (i >> k & 1) for k in range(9)]) for i in range(512)]
    morse = b"".join(b"ab"[bin(i).count("1") & 1 :][:1] for i in range(4096))  # equal under every polynomial hash modulo 2^64
    words += [morse[:n].translate(t) for n in (256, 512, 1024, 4096) for t in (None, bytes.maketrans(b"ab", b"ba"))]
    for w in set(words):
        (h,) = text.word_hashes(w).tolist()
        assert seen.setdefault(h, w) == w
        assert text.word_hashes(b" x " + w + b"\n" + w).tolist()[1:] == [h, h]
    split = b" ".join(words * 300)
    assert len(split) > text.CHUNK and text.word_hashes(split).tolist() == [text.word_hashes(w)[0] for w in words] * 300


def test_escapes_are_reversible():
    for t in texts(500, 9, ["<", "\\", "|", "im_end", "im_start", ">", "<|im_end|>", "<\\|im_end|>", "x", "\n"]):
        assert chat_format.unescape_text(chat_format.escape_text(t)) == t and chat_format.unescape_role(chat_format.escape_role(t)) == t
        chat_format.format_turn(t, t[::-1], ("assistant",))


def brute_jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(spark, docs_of, edge_docs):
    keys = np.random.default_rng(1).integers(0, 2**63, 2000, dtype=np.uint64)
    for n in (1, 2, 8, 9, 100):
        assert sharding.jump(keys, n).tolist() == [brute_jump(int(k), n) for k in keys]
    cases = [(i, f"text {i}") for i in range(3000)] + [(7, "again")] * 9000 + [(8, None), (None, "x"), (9, "é")]
    rows = sharding.assign_shards(docs_of(cases)).collect()
    assert len(rows) == len(cases)
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    for r in rows:
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
    by = Counter((r.doc_id, r["size"], r.text_crc32) for r in rows)
    assert by == Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in cases)
    assert len({r.shard for r in rows if r.doc_id == 7}) == 1
    assert sharding.assign_shards(edge_docs.limit(0)).collect() == []


def test_classifier_learns_and_holds_out(spark, docs_of, edge_docs):
    r = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    cases, labels = [], []
    for i in range(900):
        good = r.random() < 0.8
        body = [r.choice(words) for _ in range(80)]
        cases.append((i, " ".join(body) if good else " ".join(w + "##" * (r.random() < 0.5) for w in body)))
        labels.append((i, int(good)))
    lab = spark.createDataFrame([*labels, (5, None), (None, 1), (10**6, 0)], "doc_id long, quality int")
    docs = docs_of(cases)
    model = quality_classifier.train(docs, lab)
    got = {x.doc_id: x for x in quality_classifier.score_texts(docs, model).collect()}
    want = dict(labels)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.5) for i in want)
    out = [i for i in want if got[i].held_out]
    assert np.mean([got[i].predicted == want[i] for i in out]) > 0.97
    assert quality_classifier.score_texts(edge_docs, model).count() == 9
    none = quality_classifier.train(docs, lab.limit(0))
    assert {x.score for x in quality_classifier.score_texts(docs, none).collect()} == {0.5}


def test_classifier_fits_one_row_of_each_key(spark, docs_of, monkeypatch):
    free = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1][:40]
    cases = [(free[0], f"same key {j}") for j in range(300)] + [(i, f"text of {i}" + " ##" * (i % 2)) for i in free[1:]]
    labels = spark.createDataFrame([(i, i % 2) for i in free], "doc_id long, quality int")
    fitted = []
    monkeypatch.setattr(quality_classifier, "fit_model", lambda rows, good: fitted.append((len(rows), list(good))))
    quality_classifier.train(docs_of(cases), labels, sample=len(free))
    assert fitted == [(len(free), [i % 2 for i in free])]  # not 40 copies of one key's label


def test_personal_data_in_usual_forms():
    def added(t, kind):
        return [t[a:b] for a, b in pii.find_spans(t)[kind]]

    assert pii.mask("see https://user:secret@example.com/x") == "see https://[user][email]/x"
    assert added("ssh://me:p!w@host.org", "user") == ["me:p!"]
    for t in ("Social Security Number: 123-45-6789", "İ SSN is 123-45-6789", "ssn number: (123-45-6789)", "sSn of the person 123-45-6789"):
        assert added(t, "account") == ["123-45-6789"], t
    for t in ("IBAN number: DE89370400440532013000", "My Iban is DE89 3704 0044 0532 0130 00."):
        assert len(added(t, "account")) == 1, t
    assert added("ssn with four more words 123-45-6789", "account") == [] and added("ssn is 000-45-6789", "account") == []
    assert added(f"http://{'u' * 400}:{'p' * 400}@host/", "address") == ["u" * 400 + ":" + "p" * 400]
    assert not any(pii.find_spans("http://" + "a:" * 500_000).values())
