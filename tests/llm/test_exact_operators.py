"""Operators whose results a brute-force version gives exactly."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from stratawise.llm import common, media_chunks, pii_crf, prefix_bpe, secret_scan, suffix_dedup, token_files, weak_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def counted(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_token_files_match_the_library(spark, docs, table, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    out = common.scratch(spark, "test-tokens")
    manifest = token_files.write_token_files(docs, out, path)
    got = [tuple(r) for r in token_files.read_token_files(spark, out).collect()]
    made = Counter()
    for row in table:
        ids = [*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 0]
        made[row[0], len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] += 1
    assert Counter((d, n, c) for d, _, n, c in got) == made
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in got), key=lambda d: (d is not None, d))
    assert [r[1] for r in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
    assert manifest["total"] == sum(r[2] for r in got)
    files = token_files.TokenFiles(out)
    assert len(files) == len(table) and [len(files[i]) for i in range(len(files))] == [r[2] for r in got]
    out = common.scratch(spark, "test-tokens-empty")
    assert token_files.write_token_files(empty, out, path)["total"] == 0
    assert token_files.read_token_files(spark, out).count() == 0


def test_units_are_cut_before_marks():
    import pyarrow as pa
    from tokenizers import Tokenizer

    units, codes, counts = common.text_units(pa.array(["", "word, word. word word,.!\nword", "", "Größe! word; a.b. 12. *** don't. x|y #"]))
    assert len(set(units)) == len(units) and {"word", " word", ",", ".", ",.!", ";"} < set(units)  # one unit, whatever marks follow
    assert not {" word,", " word.", " word,.!", " word;", " Größe!"} & set(units)
    assert "".join(units[k] for k in codes) == "word, word. word word,.!\nwordGröße! word; a.b. 12. *** don't. x|y #" and counts.sum() == len(codes)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, table = Tokenizer.from_file(path), token_files.tokenizer_table(path)
    parts = ["word", "a", "é", "...", "!", ",", "12", "|", "<|endoftext|>", " ", "\n", "  ", "日本", "x.y", "don't", "***", "a,b.", "ß:", "\u00a0", "_", "#", "ñ%%", "ə", "Ω."]
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(3000)]
    ids, at = common.ids_by_text(table, pa.array(texts).slice(0))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_prefix_bpe_matches_the_library(docs, table, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=prefix_bpe.load_ranks(path), special_tokens={})
    want = Counter()
    for row in table:
        ids = own.encode_ordinary(row[1] or "")
        want[row[0], len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(own.decode_bytes(ids))] += 1
    got = prefix_bpe.bpe_round_trip(docs, path, public_tokenizers.PATTERN)
    assert counted(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert prefix_bpe.bpe_round_trip(empty, path, public_tokenizers.PATTERN).count() == 0


def test_prefix_tables_grow_together(monkeypatch):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = prefix_bpe.load_ranks(path)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(11)
    parts = [b"the", b"er", b"ing", b" ", b"\xc3", b"\xa9", b"\xff", b"\x00", b"x", b"aaa", b"\xe6\x97\xa5", b"!!", b"lich", b"schen"]
    strings = [b"", b"x" * 300, *(b"".join(rng.choice(np.array(parts, dtype=object), rng.integers(1, 14))) for _ in range(5000)), bytes(range(256))]
    want = [own._core_bpe.encode_single_piece(s) if s else [] for s in strings]
    bpe, scalar, grown = prefix_bpe.PrefixBpe(ranks), prefix_bpe.PrefixBpe.extend, []
    monkeypatch.setattr(prefix_bpe.PrefixBpe, "extend", lambda self, data, table, end: (grown.append(data), scalar(self, data, table, end))[1])
    assert bpe.encode_all(strings) == want
    assert all(not s or len(s) > prefix_bpe._LONG for s in grown) and b"x" * 300 in grown  # only long ones go alone
    monkeypatch.setattr(prefix_bpe, "_PAIRS", 50)  # the kept pairs turn over
    monkeypatch.setattr(prefix_bpe, "_TOGETHER", 7)
    assert prefix_bpe.PrefixBpe(ranks).encode_all(strings[:1500]) == want[:1500]
    assert bpe.encode_all([]) == []
    with pytest.raises(ValueError, match="lacks a byte"):
        prefix_bpe.PrefixBpe({b"a": 0, b"b": 1, b"ab": 2}).encode_all([b"aba", b"abc"])
    numbers = prefix_bpe.IntMap(10)
    keys = rng.choice(1 << 40, 900, replace=False)
    for some in np.array_split(keys, 3):
        numbers.put(some, (some % 1000).astype(np.int32))
    assert (numbers.get(keys) == keys % 1000).all() and (numbers.get(keys + (1 << 41)) == -1).all()


def test_prefix_tables_append_and_edit():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoder, _ = prefix_bpe.encoder(path, public_tokenizers.PATTERN)
    data = b"thehandering" * 20
    table = prefix_bpe.PrefixTable(encoder.bpe, data[:100])
    table.append(data[100:])
    assert all(table.ids(n) == encoder.bpe.merge(data[:n]) for n in (0, 1, 7, 100, len(data)))
    redone = table.edit(60, 63, b"xy")
    assert table.ids() == encoder.bpe.merge(data[:60] + b"xy" + data[63:]) and redone < len(data) // 2
    text = prefix_bpe.EncodedText(encoder, "Some words, then")
    text.append("ce more  words.\n")
    text.edit(5, 10, "wor ds")
    assert text.text == "Some wor ds, thence more  words.\n" and text.ids == [t for u in encoder.units([text.text]) for t in u]


@pytest.mark.parametrize("group_rows", [1 << 18, 100, 2])
def test_suffix_dedup(docs, table, empty, group_rows):
    keyed = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in table})
    # Equal ids are ordered by text hash in Spark: take that order from the operator's own key.
    order = {(r["did"], r["text"]): r["dk"] for r in suffix_dedup._keyed(docs).collect()}
    keyed.sort(key=lambda k: (k[0], k[1], order[k[1] if k[0] else suffix_dedup._NO_ID, k[2]]))
    seen, result = set(), {}
    for there, doc, text in keyed:
        w = text.encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            window = tuple(w[s : s + 20])
            if window in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(window)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        result[doc if there else None, text] = (len(w), len(w) - len(kept), sha(b" ".join(kept)))
    want = Counter((r[0], *result[r[0], r[1] or ""]) for r in table)
    got = suffix_dedup.remove_repeats(docs, 20, group_rows, with_output=True)
    assert counted(got, "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert sum(n * k[2] for k, n in want.items()) > 300
    for r in got.collect():
        assert sum(r["span_words"]) == r["n_removed"]
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_groups_stay_within_their_bound():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    # One very common first word run with many goings-on, one very common window, and all else.
    letters = np.concatenate([np.c_[np.full(3000, 7), rng.integers(0, 9, (3000, 3))], np.full((2000, 4), 5), rng.integers(0, 99, (1000, 4))]).astype("<u4")
    pos = np.arange(len(letters), dtype=np.int32) * 2
    own = suffix_dedup.Suffixes(letters, rng.integers(0, 5, len(letters)), np.zeros(len(letters), dtype=np.int64), pos)
    seen, want = {}, set()
    for i in np.lexsort((own.pos, own.did)).tolist():
        if seen.setdefault(tuple(letters[i]), i) != i:
            want.add((int(own.did[i]), int(pos[i])))
    rows, got, held, most = [], set(), [], 64
    parts = [own.take(np.arange(a, min(a + 500, len(own)))) for a in range(0, len(own), 500)]
    for part in parts:
        heads, later = part.tree()
        rows += [*later.runs(), *heads.packed(1, 8, most)]
    for longer in (2, 4, None):
        sorted_rows = pa.Table.from_batches(rows).sort_by("group").to_batches(max_chunksize=3)
        out = list(suffix_dedup._subtrees(sorted_rows, longer, 4, 8, most, lambda g: held.append(g.held)))
        rows = [r for b in out if (r := b.filter(b.column("docs").is_valid())).num_rows]
        for b in out:
            for did, runs in zip(b.column("did").to_pylist(), b.column("runs").to_pylist(), strict=True):
                if runs:
                    got |= {(did, int(a) + k) for a, n in np.frombuffer(runs, "<i4").reshape(-1, 2) for k in range(n)}
    assert got == want and not rows and max(held) <= most


def test_windows_with_other_neighbours_go(spark):
    """Repeats of hardly more than a window: the words around a copy, and so the anchors of overlapping windows, are others."""
    rng = random.Random(0)
    word = lambda: f"{rng.choice('abcdefghij')}{rng.randrange(1000)}"
    run = lambda n: " ".join(word() for _ in range(n))
    bank = [run(n) for n in (20, 20, 20, 21, 22, 25, 30, 40, 60)]
    rows = [(i * 7 - 900, " ".join(rng.choice(bank) if rng.random() < 0.5 else run(rng.randrange(1, 50)) for _ in range(rng.randrange(1, 5)))) for i in range(600)]
    seen, want = set(), Counter()
    for doc, text in rows:
        w = text.split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if (window := tuple(w[s : s + 20])) in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(window)
        want[doc, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))] += 1
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert counted(got, "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_words_of_later_copies_go(spark):
    text, short = " ".join(f"w{i}" for i in range(50)), "only a few words"
    rows = [(i, text) for i in (9, 4, 4, 7)] + [(1, short), (2, short), (3, text + " more"), (None, text)]
    got = Counter(tuple(r)[:3] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(9, 50, 50), (4, 50, 50), (4, 50, 50), (7, 50, 50), (1, 4, 0), (2, 4, 0), (3, 51, 50), (None, 50, 0)])


def luhn_ok(d):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def brute_pii(t):
    out = [[], [], [], []]
    out[0] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out[1] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out[2] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn_ok(d)]
    out[3] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_pii_base_spans_and_additions(docs, table, empty):
    names = ("email", "ip", "card", "phone")
    want = Counter()
    for row in table:
        found = brute_pii(row[1] or "")
        joined = ",".join(f"{n}:{a}:{b}" for n, spans in zip(names, found, strict=True) for a, b in spans)
        want[(row[0], *map(len, found), sha(joined))] += 1
    got = pii_crf.find_pii(docs)
    assert counted(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want
    assert pii_crf.find_pii(empty).count() == 0
    for t in ("1" + "0" * 300 + ".1.1.1", "0" * 400 + "9.0.0.0", "a@b@c.com", "x@y.com@z.org p@q", "1.2.3.4.5.6.7.8 999.1.1.1", "+1234567890123456 +12 345 678 9", "4111-1111-1111-1111 4111111111111112"):
        assert [(k, a, b) for k, spans in enumerate(brute_pii(t)) for a, b in spans] == pii_crf.base_spans(t)


def test_crf_decodes_held_out_rows_and_adds_spans():
    crf = pii_crf.train(pii_crf.labelled_table())
    held = {}
    for s, w, t in pii_crf.labelled_table(200, seed=77):
        held.setdefault(s, ([], []))[0].append(w)
        held[s][1].append(t)
    tags = pii_crf._decoded(crf, [crf.scores(w) for w, _ in held.values()])
    right = sum(int(a == b) for own, (_, gold) in zip(tags, held.values(), strict=True) for a, b in zip(own, gold, strict=True))
    assert right / sum(len(g) for _, g in held.values()) > 0.97

    def added(text):
        parts = pii_crf.stretches(text)
        base = pii_crf.base_spans(text)
        return [(pii_crf.KINDS[k], text[a:b]) for k, a, b in pii_crf.added_spans(text, crf.decode([crf.scores(w) for w, _ in parts]), parts, base)]

    assert added("please call (309) 555-1438 now") == [("phone", "(309) 555-1438")]
    assert added("write bob [at] corp [dot] org.") == [("email", "bob [at] corp [dot] org")]
    assert added("Licensed under the Apache License, Version 2.0. In 2024 by 12 of them at 5.") == []


def test_stretches_decode_like_whole_texts():
    crf = pii_crf.train(pii_crf.labelled_table(200), rounds=40)
    text = "of the and " * 20 + "call (309) 555-1438 " + "der keit " * 30 + "from 10.0.0.1 on"
    words = text.split()
    whole = crf.decode([crf.scores(words)])[0]
    parts = pii_crf.stretches(text)
    near = {p: int(t) for (_, places), tags in zip(parts, crf.decode([crf.scores(w) for w, _ in parts]), strict=True) for p, t in zip(places, tags, strict=True)}
    spans = [m.span() for m in WORD.finditer(text)]
    assert [near.get(p, 0) for p in spans] == whole.tolist()


def test_addresses_in_one_word_pass_the_gate(spark, monkeypatch):
    crf = pii_crf.train(pii_crf.labelled_table())
    fill = "of the and onher erthat stion der keit " * 3

    def added(text, parts):
        spans = pii_crf.added_spans(text, crf.decode([crf.scores(w) for w, _ in parts]), parts, pii_crf.base_spans(text))
        return [text[a:b] for _, a, b in spans]

    addresses = ["bob(at)corp.com", "bob[at]corp[dot]com", "bob(at)corp(dot)org", "Bob.Smith(AT)mail-corp.com"]
    texts = [f"{fill}{a} {fill}" for a in addresses] + [f"{fill}call (309) 555-1438 {fill}bob (at) corp (dot) org {fill}item(s) x[i] at home.", f"{fill}foo(at)bar {fill}", addresses[0]]
    gated = [added(t, pii_crf.stretches(t)) for t in texts]
    assert gated == [[a] for a in addresses] + [["(309) 555-1438", "bob (at) corp (dot) org"], [], [addresses[0]]]
    rows = pii_crf.find_pii(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), crf).collect()
    assert {r["doc_id"]: r["n_added"] for r in rows} == {i: len(g) for i, g in enumerate(gated)}
    whole = [[([m[0] for m in WORD.finditer(t)], [m.span() for m in WORD.finditer(t)])] for t in texts]
    monkeypatch.setattr(pii_crf, "_near", lambda words: np.ones(len(words), dtype=bool))
    assert gated == [added(t, p) for t, p in zip(texts, whole, strict=True)]


def test_spans_in_succession_are_split():
    crf = pii_crf.train(pii_crf.labelled_table())

    def added(text):
        parts = pii_crf.stretches(text)
        return [text[a:b] for _, a, b in pii_crf.added_spans(text, crf.decode([crf.scores(w) for w, _ in parts]), parts, pii_crf.base_spans(text))]

    for want, text in (
        (["309-555-1438", "309-555-1439"], "the {} {} der keit"),
        (["309-555-1438", "309-555-1439"], "the {}, {}, der keit"),
        (["(309) 555-1438", "(487) 555-7209"], "call {} {} of the"),
        (["4111.1111.1111.1111", "5500.0000.0000.0004"], "the {}, {} der keit"),
        (["1[.]2[.]3[.]4", "5[.]6[.]7[.]8"], "from {}, {} lich"),
        (["(309) 555-1438"], "of {} +1 (487) 555-7209 keit"),  # the other one is a base span
        (["bob at corp dot com", "ann at corp dot org"], "of {}, {} der keit"),
        (["bob (at) corp (dot) org", "ann (at) corp (dot) net"], "of {} {} der keit"),
        (["bob(at)corp.com", "ann(at)corp.com"], "of {},a@b.com,{} der keit"),
        (["bob at mail dot corp dot com"], "the {} der keit"),
        (["bob at corp punkt de"], "der {} und"),
        (["bob [at] mail punto corp point com"], "the {} der keit"),
    ):
        assert added(text.format(*want)) == want

    def pieces(kind, text):
        return [text[a:b] for a, b in pii_crf._pieces(kind, text, 0, len(text), [], [])]

    assert pieces(0, "bob at corp dot com. ann at corp dot org") == ["bob at corp dot com", "ann at corp dot org"]
    assert pieces(0, "a(at)b.com,c(at)d.org") == ["a(at)b.com", "c(at)d.org"]
    assert pieces(3, "309 555 1438 487 555 7209") == ["309 555 1438", "487 555 7209"]
    assert pieces(3, "(+99) 12 3456789 +98 76 5432109.") == ["(+99) 12 3456789", "+98 76 5432109"]
    assert pieces(3, "030/1234567") == ["030/1234567"]
    assert pieces(3, "12 34") == []


def brute_secrets(t):
    rules = (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]+", r"[0-9a-f]+")
    out = []
    for k, p in enumerate(rules):
        for m in re.finditer(p, t, re.ASCII | (re.IGNORECASE if k == 0 else 0)):
            if len(m[2]) >= 12 if k == 0 else len(m[0]) >= (18, 16)[k - 1]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_secrets(docs, table, empty):
    want = Counter()
    for row in table:
        found = brute_secrets(row[1] or "")
        joined = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in found)
        want[(row[0], *[sum(k == i for _, k, _ in found) for i in range(3)], sha(joined))] += 1
    assert counted(secret_scan.find_secrets(docs), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want
    assert secret_scan.find_secrets(empty).count() == 0
    keywords = secret_scan.automaton()
    good = "ghp_" + "Zq" * 15 + secret_scan.checksum_62("Zq" * 15)
    bad = good[:-1] + ("A" if good[-1] != "A" else "B")
    assert [secret_scan.KINDS[k] for _, k, _ in secret_scan.scan(f"x {good} y {bad}", keywords)] == ["github"]
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.c2ln"
    assert [secret_scan.KINDS[k] for _, k, _ in secret_scan.scan(f"İİ {jwt} eyJhbGc.eyJz.x", keywords)] == ["jwt"]
    nested = "eyJhbGciOiJIUzI1NiJ9." + base64.urlsafe_b64encode(b'{"a":' + b"[" * 20_000).decode().rstrip("=") + ".c2ln"
    assert secret_scan.scan(nested, keywords) == []
    clean = secret_scan.redact_secrets(docs)
    assert clean.columns == docs.columns and clean.count() == len(table)
    for r in clean.collect():
        assert r["text"] is None or not brute_secrets(r["text"])
        assert (r["text"] is None and r["n_chars"] is None) or r["n_chars"] == len(r["text"])


def test_weak_rules_statistics(docs, table, empty):
    want = Counter()
    for row in table:
        t = row[1] or ""
        w = WORD.findall(t)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        seen, covered = Counter(windows), set()
        for i, x in enumerate(windows):
            if seen[x] > 1:
                covered.update(range(i, i + 5))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want[row[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed] += 1
    judged, model = weak_rules.judge(docs)
    assert counted(judged, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    for r in judged.collect():
        assert not (r["base_failed"] and r["kept"])
        # The posterior by hand from the model and the votes of its counts.
        assert 0 <= r["probability"] <= 1
    assert 0 < model.share < 1
    none, prior = weak_rules.judge(empty)
    assert none.count() == 0 and prior.share == 0.85
    plan = judged._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def test_weak_rules_em_weighs_rules():
    import random

    rng, patterns = random.Random(1), Counter()
    for _ in range(5000):
        good = rng.random() < 0.85
        fires = [rng.random() < (0.002 if good else 0.7) for _ in range(2)] + [rng.random() < 0.03]
        patterns[(*(-1 if f else 0 for f in fires), 1 if good and rng.random() < 0.9 else 0)] += 1
    model = weak_rules.fit(dict(patterns), 4)
    assert 0.7 < model.share < 0.98
    assert max(model.bad[:2]) < model.bad[2]  # the rule that fires at random meets good votes and loses weight
    assert model.log_odds((0, 0, 0, 1)) >= model.log_odds((0, 0, 0, 0)) > 0 > model.log_odds((-1, 0, 0, 1)) > model.log_odds((-1, -1, 0, 1))
    alone = weak_rules.fit({(0, 0): 900, (-1, 0): 50, (0, -1): 50}, 2)
    assert alone.log_odds((-1, 0)) < 0 < alone.log_odds((0, 0))  # rules that never meet keep their prior


def test_media(spark, docs, table, empty):
    out = common.scratch(spark, "test-media")
    manifest = media_chunks.store_media(docs, out)
    got = media_chunks.read_media(manifest, out, with_payload=True).collect()
    want, forms = Counter(), {}
    for row in table:
        raw = (row[1] or "").encode()
        p = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        want[row[0], len(raw), len(p), sha(p), zlib.crc32(p[-16:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    for r in got:
        assert forms.setdefault(bytes(r["payload"]), (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])
    # The stored form is what lies in the packs, and the feature that of the payload.
    listed = {(r["row"], r["doc_id"]): [(c["pack"], c["at"], c["length"]) for c in r["chunks"]] for r in manifest.collect()}
    raw = {p: open(f"{out.removeprefix('file://')}/{p}", "rb").read() for p in {p for chunks in listed.values() for p, _, _ in chunks}}
    stored = Counter((d, len(b"".join(x)), sha(b"".join(x))) for (_, d), chunks in listed.items() for x in [[raw[p][a : a + n] for p, a, n in chunks]])
    assert stored == Counter((r["doc_id"], r["media_bytes"], r["media_sha256"]) for r in got)
    counts = Counter((d, len(chunks)) for (_, d), chunks in listed.items())
    assert counts == Counter((r["doc_id"], int(r["feature"].split(";")[0].removeprefix("chunks="))) for r in got)
    for r in got:
        p = bytes(r["payload"])
        assert r["feature"].split(";")[1:] == [f"sum={sum(p)}", f"variation={sum(abs(a - b) for a, b in zip(p, p[1:]))}", f"peak={max(p)}", f"levels={len(set(p))}"]
    # Each chunk is stored once, in one pack.
    places = {(c["digest"], c["pack"], c["at"]) for r in manifest.collect() for c in r["chunks"]}
    assert len(places) == len({p[0] for p in places})
    store, root = common.open_fs(out)
    stored = sum(len(media_chunks.PackReader(out).places(f.base_name)) for f in store.get_file_info(__import__("pyarrow.fs").fs.FileSelector(root)))
    assert stored == len(places)
    out = common.scratch(spark, "test-media-empty")
    assert media_chunks.read_media(media_chunks.store_media(empty, out), out).count() == 0


def test_packs_are_rewritten_by_many_tasks(spark):
    text = " ".join(f"word{i}" for i in range(4000))
    docs = spark.createDataFrame([(i, text + f" {i}") for i in range(12)], "doc_id long, text string").repartitionByRange(12, "doc_id")
    out = common.scratch(spark, "test-media-tasks")
    cut = media_chunks._cut(docs, out)
    index = media_chunks._compacted(cut, out, 12)
    assert index.select("pack").distinct().count() == 12
    assert index.rdd.getNumPartitions() > 4


def test_chunks_follow_content():
    import numpy as np

    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 60_000, dtype=np.uint8).tobytes()

    def cut(raw):
        points = media_chunks.cut_points(np.frombuffer(raw, dtype=np.uint8)).tolist()
        ends = media_chunks.chunk_ends(points, 0, len(raw))
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    one, two = cut(data), cut(b"inserted" + data)
    assert b"".join(one) == data and all(len(x) <= media_chunks.LARGEST for x in one)
    assert len(set(one) & set(two)) >= len(one) - 3
