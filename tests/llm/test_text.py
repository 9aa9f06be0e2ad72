import glob
import gzip
import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from termsieve.llm import bpe, chat, kept, packing, warc
from termsieve.llm.kept import Kept
from termsieve.llm.registry import HARD

from .edge import PROSE, TEXTS, docs, key

BYTE, WORDS = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("word_bpe_49k.json"))
ODD = ["", "  ", "a\n\n  b\tc  ", "x y  \nz", "don't we'll I'm <|endoftext|> x<|endoftext|>", "<|ENDOFTEXT|> A", "aaaaaaaaaaa aaaaaaa", "日本語 テスト 123456 ½", "é" * 50, "a" * 5000, "\x1c\x1d a\x1eb", "  x  　  ", "Σίσυφος ΣΑΣ İstanbul é ﬁ", "\r\n \r\n x", "word..., (word). \"word\" é. »é». a.b,c ***", "'s 're don't.", "\x85b \x0b\x0c", "A\u030a a\u0301. n\u0303,"]
sha = lambda b: hashlib.sha256(b).hexdigest()


def test_byte_bpe_equals_the_library(spark):
    lib = Tokenizer.from_file(BYTE)
    rows = TEXTS + [(9000 + i, t) for i, t in enumerate(ODD)]
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(lib.decode(ids, skip_special_tokens=False).encode())))
    got = [tuple(r) for r in bpe.encode_decode(docs(spark, rows), BYTE).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert bpe.encode_decode(docs(spark, []), BYTE).count() == 0


_lib, _codec = Tokenizer.from_file(BYTE), bpe.Codec(BYTE)
_word_lib, _word_ids = Tokenizer.from_file(WORDS), packing.WordIds(WORDS)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(list(" \n\t.,!'*<|>aAsStTzZ09éÉßñ»")), st.characters(exclude_categories=["Cs"], max_codepoint=0x2FFF)), max_size=60))
def test_any_text(text):
    ids, n, back = next(_codec.encode([text.encode()]))
    want = _lib.encode(text, add_special_tokens=False).ids
    assert ids.decode() == ",".join(map(str, want)) and n == len(want) and back.decode() == text
    assert next(_word_ids.encode([text.encode()])).tolist() == _word_lib.encode(text, add_special_tokens=False).ids


def test_kept_table_is_bounded():
    asked = []

    def square(keys):
        asked.extend(keys)
        return [k * k for k in keys]

    table = Kept(square, 100)
    r = random.Random(1)
    for _ in range(300):
        keys = {r.randrange(60) for _ in range(20)} | {r.randrange(100_000) for _ in range(5)}
        got = table.of(keys)
        assert all(got[k] == k * k for k in keys)
        assert len(table.young) + len(table.old) <= 150
    assert len(asked) < 300 * 15


def test_a_worker_frees_what_other_operators_left():
    kept.held("mine")["a"], kept.held("other")["b"] = 1, 2
    kept.others_go("mine")
    assert kept.held("mine") == {"a": 1} and kept.held("other") == {}
    kept.others_go()
    assert kept.held("mine") == {}


def check_packing(rows, got, window=4096):
    lib = Tokenizer.from_file(WORDS)
    by_doc: dict = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    texts: dict = {}
    for i, t in rows:
        texts.setdefault(i, []).append(np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4"))
    assert set(by_doc) == set(texts)
    for i, some in texts.items():
        for n in {len(x) for x in some}:
            equal = [x for x in some if len(x) == n]
            covered = np.zeros(n, int)
            for p in by_doc[i]:
                if p.doc_tokens == n:
                    covered[p.start : p.start + p.length] += 1
                    assert p.ids_crc32 in {zlib.crc32(x[p.start : p.start + p.length].tobytes()) for x in equal}
            assert (covered == len(equal)).all()
    by_sequence: dict = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_packing(spark):
    got = packing.pack(docs(spark, TEXTS).repartition(3), WORDS).collect()
    assert check_packing(TEXTS, got) == 0
    assert packing.pack(docs(spark, []), WORDS).count() == 0
    one = packing.pack(docs(spark, [(1, None), (1, None)]), WORDS).collect()
    assert [(r.start, r.length, r.doc_tokens) for r in one] == [(0, 1, 1)] * 2


@pytest.mark.parametrize("tokens", [20_000, 1 << 23])
def test_packing_carries_open_windows_over_partitions(spark, tokens):
    r = random.Random(3)
    rows = [(i, " ".join(r.choices(PROSE, k=r.randint(1, 9)))) for i in range(240)]
    packed = packing.pack(docs(spark, rows).repartition(12), WORDS, tokens=tokens)
    got = packed.collect()
    assert check_packing(rows, got) == 0
    total = {}
    for x in got:
        total[x.sequence_id] = total.get(x.sequence_id, 0) + x.length
    assert sum(n < 4096 for n in total.values()) <= 12 * -(-sum(total.values()) // tokens)
    assert max(x.sequence_id >> 56 for x in got) >= 1
    cut = {x.doc_id for x in got if x.doc_tokens <= 4096 and x.length < x.doc_tokens}
    assert tokens == 20_000 or len(cut) < 240 / 3
    assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, got))


def test_sum_of_squares_choice():
    p = packing.Packer(64)
    r, open_ = random.Random(4), []
    for i in range(400):
        size = r.randint(1, 63)
        options = {0, *(x for x in open_ if x + size <= 64)}

        def cost(fill):
            n = [0] * 64
            for x in open_:
                n[x] += 1
            n[fill] -= bool(fill)
            if fill + size < 64:
                n[fill + size] += 1
            return sum(x * x for x in n)

        fill = p.choose(size)
        assert fill in options and cost(fill) == min(map(cost, options))
        if fill:
            open_.remove(fill)
        if fill + size < 64:
            open_.append(fill + size)
        list(p.add(i, np.ones(size, "<u4")))
    assert sorted(open_) == [f for f in range(64) for _ in p.open[f]]


TURNS = [(1, 0, "user", "hi"), (1, 1, "assistant", "a <b> ### c \\ </turn>\n"), (1, 1, "assistant", "tie"), (1, 2, None, None), (2, 0, "assistant", ""), (None, 0, "us:er#<", "x"), (3, None, "user", "first"), (3, 0, "assistant", HARD), (3, 0, "assistant", HARD), (4, 0, "user", "long " * 50000)]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame([(*t, "p", "r") for t in TURNS], "conv_id long, turn long, role string, text string, prompt string, response string")
    pieces = chat.format_pieces(chat.turns_of_table(rows))
    by: dict = {}
    for c, turn, role, text in sorted(((c, t, r or "", x or "") for c, t, r, x in TURNS), key=lambda v: (str(v[0]), v[1] is not None, v[1:])):
        by.setdefault(c, []).append((role, text))
    got = {r.conv_id: r for r in chat.read_back(pieces).collect()}
    whole: dict = {}
    for p in sorted(pieces.collect(), key=lambda p: (p.conv_id is None, p.conv_id or 0, p.piece)):
        assert p.start == len(whole.get(p.conv_id, ""))
        whole[p.conv_id] = whole.get(p.conv_id, "") + p.formatted
    for c, turns in by.items():
        assert chat.parse(whole[c]) == turns
        loss = "".join(t for r, t in turns if r == "assistant")
        want = (c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns).encode()), len(loss), sha(loss.encode()), len(whole[c]))
        assert tuple(got[c]) == want
    assert chat.read_back(chat.format_pieces(chat.turns_of_table(rows.limit(0)))).count() == 0
    with pytest.raises(ValueError):
        chat.turns_of_table(spark.range(1))
    with pytest.raises(ValueError):
        chat.parse("### user: no end")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=8), st.text(st.sampled_from(list("\\#<>/:turn \n")), max_size=30)), max_size=4))
def test_escapes_are_reversible(turns):
    assert chat.parse("".join(chat.format_turn(*t)[0] for t in turns)) == turns


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 1},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "score": {"x": [1]}},
        {"turns": [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}]},
        {"messages": [{"author": {"role": "user"}, "content": {"text": "q"}}, {"author": {"role": "assistant"}, "content": {"text": "a"}}]},
        {"instruction": "q", "input": "", "output": "a"},
        {"instruction": "q", "output": "a"},
        {"prompt": "q", "completion": "a", "extra": None},
        {"question": "q", "answer": "a"},
        {"instruction": "q", "response": "a"},
        {"prompt": "q", "response": "a"},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, "{}"), (91, "not json"), (92, None), (93, '{"system":"s","instruction":"q","output":"a"}'), (94, '{"instruction":"q","input":"more","output":"a"}')], "id long, raw string")
    got: dict = {}
    for r in sorted(chat.turns_of_json(df, "id", "raw").collect(), key=lambda r: (r.conv_id, r.turn or 0)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert all(got[i] == [("user", "q"), ("assistant", "a")] for i in range(len(records)))
    assert got[90] == got[91] == got[92] == [(None, None)]
    assert got[93][0] == ("system", "s") and got[94] == [("user", "q"), ("user", "more"), ("assistant", "a")]
    assert len({x.fingerprint for x in chat.LAYOUTS}) == len(chat.LAYOUTS)
    # The table decides: under a record's fingerprint it has what the record is read by.
    paths = chat.record_paths({"prompt": "q", "response": "a", "completion": "b", "other": 1})
    chat.TABLE.pop(chat.hashed({"prompt", "response", "completion"}), None)
    assert chat.select_layout(paths).name == "prompt_response"  # of two the one declared first
    assert chat.TABLE[chat.hashed({"prompt", "response", "completion"})].name == "prompt_response"
    for x in chat.LAYOUTS:
        assert chat.TABLE[x.fingerprint] is x and chat.select_layout(set(x.paths) | {"other"}) is x
    nested = spark.createDataFrame([(7, [("human", "x"), ("gpt", "y")])], "conv_id long, conversations array<struct<from:string,value:string>>")
    assert [(r.turn, r.role, r.text) for r in chat.turns_of_table(nested).collect()] == [(0, "human", "x"), (1, "gpt", "y")]
    pairs = spark.createDataFrame([(7, "x", "y")], "conv_id long, prompt string, response string")
    assert sorted((r.turn, r.role, r.text) for r in chat.turns_of_table(pairs).collect()) == [(0, "user", "x"), (1, "assistant", "y")]


PAGES = [(1, "http://a/", "x" * 120), (2, "http://a b/é", "x" * 120), (2, "http://a/", "x" * 120), (3, None, None), (4, "http://c/", ""), (5, "u", "y" * 99), (6, "u", "y" * 99), (7, "u", "WARC/1.1\r\n\r\nHTTP/1.1 \r\n\r\n" + "z" * 200), (8, "u", "WARC/1.1\r\n\r\nHTTP/1.1 \r\n\r\n" + "z" * 200), (None, "u", "x" * 120), (9, "u", "é" * 50), (10, "u", "é" * 50)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(*p, "d", 1) for p in PAGES], "page_id long, url string, html string, digest string, size int")
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        same = [j for j, _, g in PAGES if (g or "") == (h or "") and j is not None]
        first = min(same) if len(b) >= 100 else i
        revisit = first != i and i is not None
        want.append((i, len(b), sha(b), "revisit" if revisit else "response", first if revisit else None))
    got = [tuple(r) for r in warc.archive_round_trip(df).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_archives_are_cut_by_records_and_bytes(spark, tmp_path):
    pages = [(i, f"http://x/{i}", "z" * (i * 37 % 900)) for i in range(200)] + [(500, "http://big/", "b" * 20_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    for records, size in ((16, 1 << 25), (64, 4000)):
        arc, out = str(tmp_path / f"arc{records}"), str(tmp_path / f"warc{records}")
        warc.write_arc(df, arc, records=records, most=size)
        files = [gzip.open(f).read() for f in glob.glob(f"{arc}/part-*")]
        assert len(files) > 10 and all(f.startswith(b"filedesc://pages-0-") for f in files)
        assert {r.version for f in files for r in warc.parse_arc(f)} == {1, 2}
        assert all(len(f) < size + 25_000 and len(list(warc.parse_arc(f))) < records for f in files)
        warc.convert(spark, arc, out, records, size)
        got = {(r.page_id, r.payload_bytes, r.payload_digest, r.target_uri) for r in warc.read_warc(spark, out).collect()}
        assert got == {(i, len(h), sha(h.encode()), u) for i, u, h in pages}


def test_arc_versions():
    for version in (1, 2):
        raw = warc.arc_head(version, "n.arc", "20200102030405") + warc.arc_record(version, "http://a/b c", "20200102030405", b"HTTP/1.0 200 OK\r\nX: y\r\n\r\nbody\nbody") + warc.arc_record(version, "http://d/", "2020", b"plain")
        one, two = warc.parse_arc(raw)
        assert one.fields["url"] == "http://a/b%20c" and one.version == version and two.content == b"plain"
        [(f, block)] = warc.parse_warc(warc.to_warc(one) + b"\r\n\r\n")
        assert f["warc-type"] == "response" and f["warc-date"] == "2020-01-02T03:04:05Z" and block == one.content
        assert f["warc-payload-digest"] == "sha256:" + sha(b"body\nbody")
        [(f, _)] = warc.parse_warc(warc.to_warc(two))
        assert f["warc-type"] == "resource" and f["warc-date"].startswith("2020")
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"http://a 0.0.0.0 2020 text/html 10\nshort"))
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"no header line"))
