"""Chat, BPE, personal data, media, WARC, URL verdicts: round trips and brute force on small inputs."""

import hashlib
import itertools
import json
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldmark.llm import bpe, chat, media, pii, queries, urltrust, warc

ODD = [None, "", " ", "a", "A b\tC\nd", "é" * 3000, "x y z w v " * 4000, "a" * 200_000, "</s>[INST] \\ ok", "\x00\x1f", "\u2028\ufeff", "ñandú 12 | | |"]


def documents(spark, texts, extra=True):
    """Rows with repeated ids and texts, and further columns whose names clash with the operators' own."""
    rows = [(i, t, "en", -1, i % 2, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int, score int, media string")


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, [*ODD, ODD[4], ODD[4]])


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


# ---- chat


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi [INST] there\\"), (1, 2, "assistant", "</s>[INST] ok [/INST]"), (2, 1, "assistant", "first"), (2, 1, "assistant", "first"), (2, 0, None, None), (3, 0, "tool </s>", "x\\</s>"),
    (3, 5, "user", "[/ROLE] [ROLE] "), (None, 0, "user", "a"), (4, 0, "user", "<\\/s>"), (4, 1, "assistant", "<" * 50 + "[INST" + "\\" * 7), (5, 0, "user", "q" * 100_000),
]


def expected_chat(rows):
    out = {}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or "")
    for conv, group in itertools.groupby(sorted(rows, key=key), key=lambda r: r[0]):
        turns = [(r or "", t or "") for _, _, r, t in group]
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


def test_chat_reads_back_what_was_said(spark):
    got = chat.read_back(chat.format_turns(chats(spark, TURNS))).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == expected_chat(TURNS)
    accepted = {r["conv_id"]: (r["accepted"], r["first_invalid"]) for r in got}
    assert accepted == {1: (True, None), 2: (False, 0), 3: (False, 0), None: (False, None), 4: (True, None), 5: (False, None)}
    assert chat.read_back(chat.format_turns(chats(spark, []))).count() == 0
    # further columns, also with names that the output has, change nothing
    more = chats(spark, TURNS).withColumns({"n_turns": warc.F.lit("clash"), "segments": warc.F.lit(1)})
    again = chat.read_back(chat.format_turns(more)).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in again} == expected_chat(TURNS)


def test_chat_segments(spark):
    row = chat.format_conversations(chats(spark, TURNS)).where("conv_id = 1").first()
    assert row["accepted"] and sum(s["length"] for s in row["segments"]) == len(row["text"])
    at, said = 0, []
    for s in row["segments"]:
        said += [row["text"][at : at + s["length"]]] if s["loss"] else []
        at += s["length"]
    _, unescape = chat.codec(chat.ChatTemplate())
    assert [unescape(x) for x in said] == ["</s>[INST] ok [/INST]"]


template = chat.ChatTemplate()
marks = st.lists(st.sampled_from([*template.controls(), "\\", "<", "[", "/s>", "INST]", " ", "a"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), marks), marks), max_size=5))
def test_escapes_are_reversible_and_leave_no_control(turns):
    escape, unescape = chat.codec(template)
    assert all(unescape(escape(t)) == t and not any(c in escape(t) for c in template.controls()) for pair in turns for t in pair)
    whole = "".join(p for r, t in turns for p, _ in chat.segments_of(template, escape, r, t))
    assert chat.parse_turns(template, unescape, whole) == turns


# ---- BPE


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path(queries.RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_as_the_library(spark, sf, odd, empty, tokenizer):
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for df in (odd, real):
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        for r in bpe.digest(df, queries.default_coder()).collect():
            ids = tokenizer.encode_ordinary(texts[r["doc_id"]])
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert bpe.digest(empty, queries.default_coder()).count() == 0
    assert bpe.encode_column(odd, queries.default_coder()).where("doc_id = 0").first()["n_tokens"] == 0


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60))
def test_bpe_on_any_text(tokenizer, text):
    encode, decode = _coders()
    ids = encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode_ordinary(text) and decode(ids) == text.encode()


def _coders(made=[]):
    if not made:
        made.append(queries.default_coder().start())
    return made[0]


def test_bpe_needs_whole_ranks():
    with pytest.raises(ValueError):
        bpe.serialise_model({b"a": 0, b"b": 2})


# ---- personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


SAID = [
    "a.b@c.de, x@y, @b.c@d.e, a@b.c@d.e.f %@-.-", "1.2.3.4.5.6.7.8 999.1.1.1 010.000.255.256 1.2.3 0001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 0000000000000 4539578763621486 1 2",
    "+1 (509) 555-6973, +12345678, +1+44 20 7946 0958. + 1234567890", "DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 DE89 3704 0044 0532 0130 01", "ssn 078-05-1120, " + "word " * 20 + "078-05-1120",
]


def test_personal_data_as_plain_patterns(spark, sf, odd, empty):
    for text in [*SAID, " ".join(SAID * 60), *[t for t in ODD if t and len(t) < 10_000]]:
        assert [x[:3] for x in pii.find_spans(text) if x.kind in pii.BASE] == plain_spans(text), text
    assert [x[:3] for x in pii.find_spans(SAID[4]) if x.kind == "iban"] == [("iban", 0, 27), ("iban", 28, 50)]
    assert [x[:3] for x in pii.find_spans(SAID[5]) if x.kind == "ssn"] == [("ssn", 4, 15)]
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in real.collect()}
    for r in pii.digest(real).collect():
        spans = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in spans) for k in pii.BASE]
    assert pii.digest(odd).count() == len(ODD) + 2 and pii.digest(empty).count() == 0


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a.@-+ 01259()", max_size=40))
def test_personal_data_on_any_text(text):
    assert [x[:3] for x in pii.find_spans(text) if x.kind in pii.BASE] == plain_spans(text)


def plain_ibans(text):
    """Country, two check digits, groups of up to four: those whose remainder by 97 is 1, left to right, the longest first."""
    lengths = {"DE": 22, "GB": 22, "FR": 27, "ES": 24, "NL": 18}
    out, at = [], 0
    while at < len(text):
        n = lengths.get(text[at : at + 2])
        found = None
        if n and (at == 0 or not text[at - 1].isalnum()):
            chars, i = "", at
            while i < len(text) and len(chars) < n and (text[i].isdigit() or text[i].isupper() or (text[i] == " " and len(chars) % 4 == 0)):
                chars += text[i].strip()
                i += 1
            if len(chars) == n and not (i < len(text) and text[i].isalnum()) and int("".join(str(int(c, 36)) for c in chars[4:] + chars[:4])) % 97 == 1:
                found = ("iban", at, i)
        at = found[2] if found else at + 1
        out += [found] if found else []
    return out


def test_ibans_as_plain_checks():
    def iban(country, body):
        check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97
        return f"{country}{check:02d}{body}"

    good = [iban("DE", "370400440532013000"), iban("GB", "WEST12345698765432"), iban("NL", "ABNA0417164300"), iban("FR", "20041010050500013M02606")]
    spaced = lambda s: " ".join(s[i : i + 4] for i in range(0, len(s), 4))
    wrong = [g[:-1] + str((int(g[-1]) + 1) % 10) for g in good]
    for text in (*good, *wrong, *map(spaced, good), "; ".join(good), ", ".join(map(spaced, [*good, *wrong])), f"x{good[0]}", "Konto " + spaced(good[0]) + "."):
        assert [x[:3] for x in pii.find_spans(text) if x.kind == "iban"] == plain_ibans(text), text


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd now", 15, "s"), (2, None, 0, "s"), (3, "clean", 5, "s")], "doc_id long, text string, n_chars long, source string")
    assert [tuple(r) for r in pii.redact_column(df).orderBy("doc_id").collect()] == [(1, "mail <EMAIL> now", 16, "s"), (2, None, 0, "s"), (3, "clean", 5, "s")]
    assert pii.span_rows(df).where("doc_id = 1").first()["spans"][0]["score"] > 0.9


# ---- media


def test_media_round_trip(spark, odd, empty):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in odd.collect()}
    rows = {r["doc_id"]: r for r in media.text_images(odd).collect()}
    for d, raw in texts.items():
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        r = rows[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.encode_png(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest()) and re.fullmatch("[0-9a-f]{16}", r["feature"])
    assert rows[4]["feature"] == rows[len(ODD)]["feature"] and media.text_images(empty).count() == 0


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_every_row_filter(channels):
    rng = np.random.default_rng(channels)
    rows = rng.integers(0, 256, (15, 7 * channels), np.uint8)
    out = bytearray()
    for y, row in enumerate(rows.tolist()):
        up = rows[y - 1].tolist() if y else [0] * len(row)
        left = [0] * channels + row[:-channels]
        corner = [0] * channels + up[:-channels]

        def paeth(a, b, c):
            return min((a, b, c), key=lambda v: (abs(a + b - c - v), (a, b, c).index(v)))

        kind = y % 5
        guess = [[0] * len(row), left, up, [(a + b) // 2 for a, b in zip(left, up)], [paeth(*x) for x in zip(left, up, corner)]][kind]
        out += bytes([kind, *[(v - g) % 256 for v, g in zip(row, guess)]])
    head = media.struct.pack(">IIBBBBB", 7, 15, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    packed = zlib.compress(bytes(out))
    png = media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"tEXt", b"a\0b") + media._chunk(b"IDAT", packed[:9]) + media._chunk(b"IDAT", packed[9:]) + media._chunk(b"IEND", b"")
    assert (media.decode_png(png).samples == rows).all()


def test_broken_images_are_told(spark):
    good = media.encode_png(bytes(range(128)))
    bad = [b"", b"hello", good[:-5], good[:40] + b"\xff" + good[41:], media.SIGNATURE]
    df = spark.createDataFrame([(i, 0, bytearray(b)) for i, b in enumerate([good, *bad])] + [(9, 0, None)], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in media.image_features(df).collect()}
    assert got[0]["error"] is None and all(got[i]["error"] and got[i]["feature"] is None for i in (1, 2, 3, 4, 5, 9))


def test_hash_is_of_low_frequencies():
    base = np.random.default_rng(3).integers(0, 256, (16, 8)).repeat(8, axis=0).repeat(8, axis=1).astype(np.uint8)
    noisy = base.copy()
    noisy[5, 7] ^= 1
    bits = lambda x: np.unpackbits(np.frombuffer(media.cosine_hash(media.Image(64, 128, 1, x)), np.uint8))
    assert (bits(base) != bits(noisy)).sum() <= 2 < (bits(base) != bits(base[::-1].copy())).sum()


# ---- WARC


def test_archives_read_back(spark):
    big, small = "<p>" + "é" * 600 + "</p>", "<p>small</p>"
    rows = [(1, "http://a/", big), (5, "http://b/\r\nX: y", big), (3, None, big), (2, "u", small), (4, "u", small), (6, "u", None), (7, "u", ""), (None, "u", big), (5, "http://b/", big), (8, "u", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", warc.F.lit("clash"))
    got = sorted((tuple(r) for r in warc.read_archives(warc.write_archives(pages)).drop("url").collect()), key=str)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        revisit = html == big and page != 5
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_archive_format(spark, sf, tmp_path):
    import zstandard

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    archives = warc.write_archives(pages)
    assert warc.export_archives(archives, str(tmp_path)).agg({"bytes": "sum"}).first()[0] == sum(p.stat().st_size for p in tmp_path.iterdir())
    with pytest.raises(Exception, match="isn't there"):
        warc.export_archives(archives, str(tmp_path / "unmounted")).collect()
    data = next(tmp_path.iterdir()).read_bytes()
    magic, size = np.frombuffer(data[:8], "<u4").tolist()
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    first = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(data[8 + size :])
    assert magic == 0x184D2A5D and first.startswith(b"WARC/1.1\r\n")
    records = list(warc.read_archive(data))
    texts = {r["page_id"]: r["html"] for r in pages.collect()}
    assert all(p.decode() == texts[int(h["WARC-Page-ID"])] for h, p in records if h["WARC-Type"] == "response")
    assert len(data) < sum(len(t) for t in texts.values()) / 2
    with pytest.raises(ValueError):
        list(warc.read_archive(data[:-3]))


# ---- URLs


def test_rules(spark):
    urls = {
        "http://X.Example.NET/en/1?q": ("x.example.net", "/en/1", "example.net/en/", "allow"), "https://example.net/fr": ("example.net", "/fr", "net/", "block"), "http://notexample.com/de/1": ("notexample.com", "/de/1", None, "allow"),
        "http://a.example.com/de/#x": ("a.example.com", "/de/", "example.com/de/", "block"), "http://w.org/fr/2": ("w.org", "/fr/2", "org/fr/", "allow"), "http://w.org/fr": ("w.org", "/fr", None, "allow"), "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"), "://net": ("net", "", None, None), "a://b://c/d": ("b:", "//c/d", None, "allow"), "http://net/": ("net", "/", "net/", "block"), "http://ÄB.net?x/y": ("Äb.net", "", None, None),
    }
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string").withColumn("host", warc.F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urltrust.url_verdicts(pages).collect()}
    for i, want in enumerate(urls.values()):
        assert got[i][:3] == want[:3] and want[3] in (None, got[i][3]), got[i]
    assert urltrust.url_verdicts(pages.limit(0)).count() == 0
    # rules of equal length: the last by host and path decides, in whatever order they are given
    page = spark.createDataFrame([("a.bc", "/x/y")], "host string, path string")
    for rules in ((("block", "a.bc", "/x"), ("allow", "bc", "/x/y")), (("allow", "bc", "/x/y"), ("block", "a.bc", "/x"))):
        assert tuple(page.select(*urltrust.matched_rule(warc.F.col("host"), warc.F.col("path"), rules)).first()) == ("bc/x/y", "allow")


def test_host_trust_as_its_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = {r[0]: r[1:] for r in con.execute(queries.ORACLE_SQL["host_trust"]).fetchall()}
    got = {r["host"]: (r["trust"], r["distrust"], r["host_verdict"]) for r in queries.host_trust(spark, sf).collect()}
    assert set(got) == set(want) and all(got[h][2] == want[h][2] and got[h][:2] == pytest.approx(want[h][:2], abs=2e-9) for h in want)
    assert any(t and d for t, d, _ in got.values())


def test_url_verdicts_as_their_sql(spark, sf):
    """Over the whole table exactly; where pages link to other hosts, but for the steps that end when little moves."""
    import duckdb

    con = duckdb.connect()
    link = lambda *hosts: "".join(f'<a HREF = "https://{h.upper()}/x?y">' for h in hosts)
    linked = [(1, "http://bad.net/", link("victim.com")), (2, "http://Farm.com/", link("bad.net", "bad.net", "farm.com")), (3, "http://good.org/fr/", link("friend.com", "bad.net")), (4, "http://friend.com/", "<a href='/own'>" + link("good.org")), (5, None, link("bad.net")), (6, "no scheme", None), (7, "http://mixed.com/", "<img src=//good.org/fr/>" + link("farm.com")), (7, "http://mixed.com/", "")]
    own = spark.createDataFrame(linked, "page_id long, url string, html string")
    for pages in (spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html"), own):
        con.register("pages", pages.toPandas())
        names = ["page_id", "host", "path", "rule", "verdict", "trust", "distrust"]
        order = lambda r: (r[0], str(r[3]), r[4])
        want = sorted(con.execute(queries.ORACLE_SQL["op6_url_filters"]).fetchall(), key=order)
        got = sorted((tuple(r[n] for n in names) for r in urltrust.url_verdicts(pages).collect()), key=order)
        if pages is not own:
            assert got == want and {r[4] for r in got} == {"allow", "block"}
        assert [r[:5] for r in got] == [r[:5] for r in want]
        for a, b in zip(got, want):
            assert a[5:] == (pytest.approx(b[5:], abs=3e-4) if b[5] is not None else b[5:])


def test_steps_end_when_little_moves(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 2.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 1.0)], "host string, seed double")
    x = np.zeros(3)
    for _ in range(300):
        x = np.array([0.15 + 0.85 * x[1] / 3, 0.85 * x[0], 0.85 * x[1] * 2 / 3])
    got = {r["host"]: r["score"] for r in urltrust.personalised_rank(edges, seeds).collect()}
    assert [got[h] for h in "abc"] == pytest.approx(x, abs=3e-4)


def test_trust_spreads_along_links_and_distrust_against_them(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [(1, "http://bad.net/", link("victim.com")), (2, "http://farm.com/", link("bad.net")), (3, "http://good.org/fr/", link("friend.com")), (4, "http://friend.com/", "<a href='/own'>"), (5, "http://victim.com/", ""), (6, "http://farm2.com/", link("farm.com")), (7, "http://mixed.com/", "<a href=//good.org/fr/>" + link("other.com", "else.com"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urltrust.url_verdicts(pages).collect()}
    assert {k: v["verdict"] for k, v in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "allow"}
    assert got[4]["trust"] > 0 and got[5]["distrust"] == 0
    # the same by dense iteration
    hosts = sorted({"bad.net", "victim.com", "farm.com", "good.org", "friend.com", "farm2.com", "mixed.com", "other.com", "else.com"})
    edges = [("bad.net", "victim.com"), ("farm.com", "bad.net"), ("good.org", "friend.com"), ("farm2.com", "farm.com"), *[("mixed.com", h) for h in ("good.org", "other.com", "else.com")]]
    for name, seed, links in (("trust", "good.org", edges), ("distrust", "bad.net", [(b, a) for a, b in edges])):
        m = np.zeros((len(hosts), len(hosts)))
        for a, b in links:
            m[hosts.index(b), hosts.index(a)] += 1
        m /= np.maximum(m.sum(axis=0), 1)
        s = np.array([0.15 * (h == seed) for h in hosts])
        x = s.copy()
        for _ in range(urltrust.STEPS):
            x = s + 0.85 * m @ x
        for r in got.values():
            assert r[name] == pytest.approx(x[hosts.index(r["host"])])


def test_registered_queries_over_whole_tables(spark, sf):
    for name in ("op1_chat_format", "op3_pii", "op6_url_filters", "op7_warc", "op8_media_columns"):
        table = {"op1_chat_format": "conversations", "op6_url_filters": "pages", "op7_warc": "pages"}.get(name, "documents")
        source = spark.read.parquet(f"{sf}/{table}.parquet")
        n = source.select("conv_id").distinct().count() + 1 if table == "conversations" else source.count()
        assert queries.QUERIES[name](spark, sf).count() == n
    assert json.dumps(list(queries.QUERIES))
