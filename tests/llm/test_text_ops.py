import functools
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from pulselake.llm import decontaminate, langid, licenses, packing, suffixes, tokens, unigram, urls
from tests.llm.edges import TEXTS, no_documents, odd_documents

BPE = public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def bpe():
    return Tokenizer.from_file(BPE)


def bpe_ids(text):
    return [*bpe().encode(text or "", add_special_tokens=False).ids, 0]


def test_piece_encoder_matches_the_library():
    encoder, rng = tokens.PieceEncoder(BPE), random.Random(5)
    assert encoder.bare and [*bpe().encode("a <|endoftext|> b", add_special_tokens=False).ids] == [64, 220, 50256, 275]
    parts = ["don't", "it's,", "a1b2$c", "<|endoftext|>", "é", "naïve,", "Straße.", "µ", "ªb", "日本", "x\tz", "\xa0", "\u2003", "--", "...", "'", "''s", "9,5", "A'll", "\x00", "\x7f", "ﬁ", "e\u0301", "🙂", "ж", "ۥ", "<|", "|>", "word" * 30]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "\n", "", "", " ", "  ", "\n\n", " \n"]) for _ in range(rng.randrange(12))) for _ in range(4000)]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        for text, got in zip(part, encoder.encode(part), strict=True):
            assert np.frombuffer(got, np.uint16).tolist() == bpe().encode(text, add_special_tokens=False).ids, repr(text)


def test_known_pieces_cost_nothing_and_a_full_table_is_right(monkeypatch):
    """Only words that aren't known go to the library, with their marks apart; a small table forgets, but rightly."""
    encoder, rng = tokens.PieceEncoder(BPE), random.Random(8)
    given = []

    class Counted:
        def encode_batch_fast(self, texts, **kw):
            given.extend(texts)
            return bpe().encode_batch_fast(texts, **kw)

    words = ["".join(rng.choice("abcdeé") for _ in range(9)) for _ in range(300)]
    encoder.encode(["of " + " ".join(words)])
    encoder.tokenizer = Counted()
    again = "of " + " ".join(w + "," for w in words) + " " + " ".join(words)
    assert np.frombuffer(encoder.encode([again])[0], np.uint16).tolist() == bpe_ids(again)[:-1]
    assert sum(map(len, given)) < 100
    monkeypatch.setattr(tokens, "CACHE_PIECES", 40)
    encoder = tokens.PieceEncoder(BPE)
    for _ in range(30):
        texts = [" ".join(rng.choice(words) + rng.choice(["", ",", "!?", "\n", "'s"]) for _ in range(rng.randrange(60))) for _ in range(3)]
        assert [np.frombuffer(b, np.uint16).tolist() for b in encoder.encode(texts)] == [bpe_ids(t)[:-1] for t in texts]


def test_ids_are_coded_once(spark, monkeypatch):
    """Range partitions sample their input first: what lies below must be a plain scan."""
    frame, below = type(spark.range(1)), []
    deal = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda df, *a: (below.append(df._jdf.queryExecution().toString()), deal(df, *a))[1])
    rows = tokens.round_trip(odd_documents(spark), BPE).collect()
    assert len(rows) == odd_documents(spark).count()
    assert below and not any("MapInArrow" in plan for plan in below)


def test_merges_that_cross_are_seen():
    cut = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}

    def apart(*merges, **more):
        return tokens.keeps_apart({"pre_tokenizer": cut, "model": {"type": "BPE", "merges": [list(m) for m in merges]}} | more)

    assert apart(("a", "b"), ("Ġ", "ab"), ("Ġ", "Ġ"), ("Ċ", "Ċ"), ("1", "2"), ("'", "s"))
    assert not apart(("a", "1")) and not apart(("a", "Ġ")) and not apart(("Ċ", "a")) and not apart(("a", "."))
    assert not apart(normalizer={"type": "NFC"}) and not apart(pre_tokenizer=None)


# --- URLs ---


def brute_verdict(url):
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(r), r, a) for a, r in rules for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules_match_brute_force(spark):
    hosts = ["example.com", "www.example.com", "WWW.Example.COM", "a.www.example.com", "example.net", "net", "com", "notexample.com", "x.org", "casino-win.org", "xcom", ""]
    paths = ["", "/", "/en", "/en/", "/en/page", "/es/x", "/fr/", "/EN/", "/en/?q=1#z", "?a=/en/", "#/es/", "/a\nb"]
    urls_ = [f"{s}://{h}{p}" for s in ("http", "https") for h in hosts for p in paths] + [None, "", "example.com/en/", "http:/x", "a://b://c.com/en/"]
    df = spark.createDataFrame([(i, u, "old", 1) for i, u in enumerate(urls_)], "page_id long, url string, rule string, token int")
    got = {r.page_id: r for r in urls.filter_urls(df).collect()}
    assert len(got) == len(urls_)
    for i, u in enumerate(urls_):
        host, path, rule, action = brute_verdict(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (action or ("block" if host.startswith("casino-") else "allow"))
    assert urls.filter_urls(df.limit(0)).collect() == []
    clash = df.selectExpr("page_id", "url", "'own' AS HOST", "'own' AS Verdict", "'own' AS paths")
    assert {r.page_id: (r.host, r.verdict, r.paths) for r in urls.filter_urls(clash).collect()} == {i: (r.host, r.verdict, "own") for i, r in got.items()}


def test_only_fetched_rules_run(spark):
    rng = random.Random(8)
    names = [f"w{i}" for i in range(3000)]
    patterns = [rng.choice(["||{0}-*", "||*-{0}.", "||ads.{0}.org/", "*/{0}/*", "||{0}.com/x|"]).format(rng.choice(names)) for _ in range(4000)]
    table = spark.createDataFrame([*(("block", p) for p in patterns), ("allow", "w1.org/"), ("block", None), ("block", patterns[0])], "action string, pattern string")
    rules = urls.rules_of(table)
    assert len(rules) == len(set(patterns)) + 1
    targets = [rng.choice(["{0}-shop.com/", "a-{0}.net/y", "ads.{0}.org/z", "b.c/{0}/{1}", "{0}.com/x", "sub.w1.org/"]).format(*rng.sample(names, 2)) for _ in range(400)]
    counts = {t: rng.randrange(50) for t in names} | dict.fromkeys(["ads", "org", "com", "x"], 1000)
    found = urls.RuleIndex(rules, counts, "allow")
    order = [(r, urls.to_regex(r.pattern)) for r in sorted(rules, key=lambda r: r.rank, reverse=True)]
    fits = [next((r for r, regex in order if regex.match(t)), None) for t in targets]
    assert [found.decide(t) for t in targets] == [(r.name, r.action) if r else (None, "allow") for r in fits]
    assert any(fits) and found.runs < 20 * len(targets) < len(rules) * len(targets) / 100
    df = spark.createDataFrame([(i, f"http://{t}") for i, t in enumerate(targets)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(df, rules).collect()}
    assert got == {i: (r.name, r.action) if r else (None, "allow") for i, r in enumerate(fits)}


def test_rare_languages_and_long_texts_are_learned(spark):
    rng = random.Random(2)
    letters = {f"l{i:02d}": "".join(rng.sample([chr(c) for c in range(0x430, 0x450)], 4)) for i in range(70)}

    def text(lang, n):
        return " ".join("".join(rng.choice(letters[lang]) + rng.choice("aeiou") for _ in range(3)) for _ in range(n))

    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5]
    rows = [(ids.pop(), text(lang, 100 if lang == "l69" else 60), lang) for lang in letters for _ in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, sample_chars=500, total_chars=70 * 1200)
    assert model.languages == sorted(letters)
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) > 0.9 * len(rows) and {got[i] for i, _, lang in rows if lang == "l69"} == {"l69"}
    assert langid.train(docs.where("lang is null")).languages == []


def test_candidate_rules_come_from_rarest_token():
    rules = [urls.pattern_rule("block", "||ads.example.com/track/"), urls.pattern_rule("block", "*shop*")]
    index, rest = urls.index_rules(rules, {"example": 90, "com": 100, "ads": 5, "track": 9})
    assert index == {"ads": [0]} and rest == [1]


# --- token files ---


def test_codec_round_trip():
    rng = np.random.default_rng(1)
    for lengths in ([0], [1], [5, 0, 3, 4], rng.integers(0, 30, 50).tolist()):
        v = (rng.random(sum(lengths)) ** 6 * (2**32 - 1)).astype(np.uint32)
        control, data = tokens.encode_values(v, np.array(lengths))
        assert [len(c) for c in control] == [-(-n // 4) for n in lengths]
        assert np.array_equal(tokens.decode_values(*(np.frombuffer(b"".join(x), np.uint8) for x in (control, data)), np.array(lengths)), v)


def test_token_files_hold_all_ids(spark):
    docs = odd_documents(spark)
    got = tokens.round_trip(docs, BPE).collect()
    assert len(got) == docs.count()
    want = sorted(((r.doc_id is None, r.doc_id or 0, bpe_ids(r.text)) for r in docs.collect()), key=lambda x: x[:2])
    got = sorted(got, key=lambda r: r.start)
    assert [(r.doc_id is None, r.doc_id or 0) for r in got] == [w[:2] for w in want]
    at = 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids)
        assert (r.doc_id is None, r.doc_id or 0, ids) in want
        at += len(ids)
    assert tokens.round_trip(no_documents(spark), BPE).collect() == []


def test_pieces_encode_as_whole_texts():
    rng = random.Random(2)
    parts = ["a", "é", "B", "1", "²", " ", " ", "\n", ".", ",", "'s", "'", "漢", "\u0301", "\u00a0", "\t", "-", "_", "?!", "🙂", "<|endoftext|>", "word", "###"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)]
    encoder = tokens.PieceEncoder(BPE)
    for a in range(0, len(texts), 500):
        for t, b in zip(texts[a : a + 500], encoder.encode(texts[a : a + 500]), strict=True):
            assert np.frombuffer(b, np.uint16).tolist() == bpe_ids(t)[:-1], t


# --- packing ---


def test_packing_is_whole_and_dense(spark):
    docs = odd_documents(spark)
    got = packing.pack(docs, BPE, capacity=64).collect()
    want = sorted(str(bpe_ids(r.text)) for r in docs.collect())
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 64
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    total = sum(r.length for r in got)
    assert total == sum(len(bpe_ids(r.text)) for r in docs.collect())
    whole = {}
    for r in got:
        if r.doc_id is not None and r.doc_id != 3:
            whole.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for i, t in enumerate(TEXTS):
        if i != 3:
            assert sum((x for _, x in sorted(whole[i])), []) == bpe_ids(t)
    assert len(want) == docs.count()
    assert packing.pack(no_documents(spark), BPE).collect() == []


def test_histogram_is_packed_whole():
    rng = random.Random(3)
    for _ in range(50):
        histogram = {n: rng.randrange(1, 40) for n in rng.sample(range(1, 101), rng.randrange(1, 30))}
        patterns = packing.pack_histogram(histogram, 100)
        count = {}
        for c, lengths in patterns:
            assert sum(lengths) <= 100
            for n in lengths:
                count[n] = count.get(n, 0) + c
        assert count == histogram


# --- language ID ---


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5):
        s, t, start = rng.normal(size=(n, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
        p = np.zeros((n, 3))
        for labels in itertools.product(range(3), repeat=n):
            w = np.exp(start[labels[0]] + sum(s[i, y] for i, y in enumerate(labels)) + sum(t[a, b] for a, b in zip(labels, labels[1:])))
            for i, y in enumerate(labels):
                p[i, y] += w
        both = langid.marginals(np.concatenate([s, s[:1]]), np.array([n, 1]), t, start)
        assert np.allclose(both[:n], p / p.sum(1, keepdims=True))


def _languages(rng, n):
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "gr", "ung"], "cc": ["ño", "cha", "rri", "lo"]}
    return [(lang, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(20, 60)))) for _ in range(n) for lang in syllables]


def test_held_out_accuracy_and_code_switching(spark):
    rng = random.Random(5)
    rows = [(i, t, lang, "s") for i, (lang, t) in enumerate(_languages(rng, 120))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.predict_languages(docs).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {i: lang for i, _, lang, _ in rows}
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    model = langid.train(docs)
    one, two = (next(t for _, t, lang, _ in rows if lang == x) for x in ("aa", "bb"))
    spans = langid.label_texts([one + " " + two], model)[3][0]
    assert [s["lang"] for s in spans][:1] == ["aa"] and [s["lang"] for s in spans][-1:] == ["bb"] and len(spans) <= 4


def test_language_of_odd_documents(spark):
    docs = odd_documents(spark)
    got = langid.predict_languages(docs).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    for i in (0, 1, 2, 10):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert {r.lang_pred for r in got} <= {"und", "en"} and all(0 <= r.score <= 1 for r in got)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {3, 4, 5, 6, 7, 8, 9}
    assert not {0, 1, 2, 10} & {r.doc_id for r in kept.collect()}
    assert langid.predict_languages(no_documents(spark)).collect() == []
    unlabelled = docs.withColumn("lang", docs["lang"].substr(9, 1)).where("false")
    assert langid.keep_identified(unlabelled).collect() == []


# --- token counts ---


@pytest.mark.parametrize("whole", [True, False])
def test_counts_match_the_unigram_model(whole):
    rng = random.Random(6)
    for _ in range(120):
        vocabulary = {"<unk>": 0.0}
        for _ in range(rng.randrange(1, 14)):
            vocabulary["".join(rng.choice("ab▁c") for _ in range(rng.randrange(1, 5)))] = float(-rng.randrange(6)) if whole else -rng.random()
        pieces = list(vocabulary.items())
        theirs = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
        theirs.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
        ours = unigram.Unigram(pieces)
        for _ in range(15):
            text = "".join(rng.choice("abc dé") for _ in range(rng.randrange(12)))
            assert ours.count(text)[1] == len(theirs.encode(text, add_special_tokens=False).ids), (pieces, text)


def test_counts_of_odd_documents(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    theirs = Tokenizer(models.Unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], unk_id=0, byte_fallback=True))
    theirs.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    docs = odd_documents(spark)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in unigram.count_tokens(docs, path).collect())
    assert got == sorted((r.doc_id is None, r.doc_id or 0, len(theirs.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert unigram.count_tokens(no_documents(spark), path).collect() == []


# --- repeated passages ---


def brute_passages(docs, k):
    """{(doc_id, start, n_words, repeat)} for documents of distinct ids."""
    places = {}
    for i, text in sorted(docs.items()):
        w = (text or "").encode().split()
        for p in range(len(w) - k + 1):
            places.setdefault(tuple(w[p : p + k]), []).append((i, p))
    first, later = {}, {}
    for at in places.values():
        if len(at) > 1:
            first.setdefault(at[0][0], set()).add(at[0][1])
            for i, p in at[1:]:
                later.setdefault(i, set()).add(p)
    out = set()
    for repeat, found in ((False, first), (True, later)):
        for i, starts in found.items():
            out |= {(i, s, n, repeat) for s, n in suffixes.merge(starts, k)}
    return out


def test_passages_match_brute_force(spark):
    rng = random.Random(7)
    for trial in range(3):
        shared = [[rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.randrange(8, 30))] for _ in range(6)]
        docs = {}
        for i in range(50):
            words = [f"u{rng.randrange(5000)}" for _ in range(rng.randrange(40))]
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(words) + 1)
                words[at:at] = rng.choice(shared)
            docs[i] = " ".join(words) if words else None
        docs[50] = "x " * 60
        docs[51] = docs[52] = " ".join(shared[0] + shared[1])
        df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
        got = {(r.doc_id, r.start, r.n_words, r.repeat) for r in suffixes.repeated_passages(df, min_words=10, window=5, gram=3).collect()}
        assert got == brute_passages(docs, 10), trial


def test_cut_passages(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"alpha beta {passage} gamma", 0, "c"), (2, f"delta {passage}\nepsilon  zeta", 0, "c"), (3, passage, 0, "c"), (4, "clean text of its own", 21, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, key_ string")
    cut = suffixes.cut_repeats(df.selectExpr("*", "'own' as repeats", "'own' as text_key"))
    assert cut.columns == ["doc_id", "text", "n_chars", "key_", "repeats", "text_key"] and {(r.key_, r.repeats, r.text_key) for r in cut.collect()} == {("c", "own", "own")}
    got = {r.doc_id: r for r in cut.collect()}
    assert got[1].text == rows[0][1] and got[2].text == "delta epsilon  zeta" and got[2].n_chars == len("delta epsilon  zeta")
    assert 3 not in got and got[4].text == "clean text of its own" and got[4].n_chars == 21


def test_passages_of_odd_documents(spark):
    docs = odd_documents(spark)
    got = suffixes.repeated_passages(docs).collect()
    assert {(r.doc_id, r.start, r.n_words, r.repeat) for r in got if r.doc_id in (8, 9)} >= {(9, 0, 80, True)}
    kept = suffixes.cut_repeats(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {0, 1, 2, 3, 4, 6, 7, 8, 10}
    assert suffixes.repeated_passages(no_documents(spark)).collect() == []
    assert suffixes.cut_repeats(no_documents(spark)).collect() == []


# --- decontamination ---

QUESTION = "A train leaves the station at 9 in the morning and travels 120 km to the coast where Anna waits for 3 hours before it goes back."


def test_reparameterised_questions_are_caught(spark):
    bench = spark.createDataFrame([(1, QUESTION, "x"), (2, None, "x"), (3, "", "x"), (4, "too short", "x"), (1, QUESTION, "x")], "item_id long, text string, doc_id string")
    clean = "An essay on trains that has nothing in common with any question of the set, though it has 120 km and Anna in it."
    swapped = QUESTION.replace("9", "7").replace("120", "80").replace("Anna", "Peter").replace("3", "5").replace("km", "miles")
    rows = [(1, "Intro words. " + QUESTION + " More."), (2, "Intro words. " + swapped), (3, clean), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, item_id int")
    got = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.verbatim) for r in got} == {(1, 1, True), (2, 1, False)} and len(got) == 4
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    assert decontaminate.contaminated(docs, bench.limit(0)).collect() == [] and decontaminate.decontaminate(docs, bench.limit(0)).count() == 5
    assert decontaminate.contaminated(docs.limit(0), bench).collect() == []


def test_slots_must_agree(spark):
    item = "If Tom has 4 apples and Tom gives 4 away"  # one window
    texts = [item.replace("4", "9"), item.replace("4 apples", "9 apples"), item.replace("Tom", "Eve")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == [0, 2]


def brute_templates(text):
    """(typed words, words) by plain rules."""
    out, own, start, number = [], [], True, False
    for word in text.split():
        core = word.strip("".join(chr(c) for c in range(33, 128) if not chr(c).isalnum() and chr(c) not in "%$+-"))
        low = core.lower()
        is_number = bool(re.fullmatch(r"[+-]?[$]?\d[\d.,:/]*(?:st|nd|rd|th|%)?", low))
        kind = "#" if is_number else "unit" if number and low.encode() in decontaminate.UNITS else "name" if core[:1] != low[:1] and not start else None
        out.append(kind or "=" + low)
        own.append(low)
        start, number = word.rstrip("\"')")[-1:] in tuple(".!?:"), is_number
    return out, own


def brute_contaminated(docs, items, window, least):
    found = []
    for d, text in docs:
        seen, own = brute_templates(text)
        for i, item in items:
            tokens, values = brute_templates(item)
            k = min(window, len(tokens))
            variants = [(tokens, range(len(tokens) - k + 1))]
            first = item.split()[0]
            if first[:1] != first[:1].lower():
                variants.append((["name", *tokens[1:]], [0]))
            hits = {}
            for p in range(len(own) - k + 1):
                for a in range(len(values) - k + 1):
                    if own[p : p + k] == values[a : a + k]:
                        hits.setdefault(p, []).append((a, True))
                for tok, at in variants if k >= least else []:
                    for a in at:
                        part = tok[a : a + k]
                        slots = [j for j in range(k) if part[j][0] != "="]
                        pairs = {(part[j], own[p + j], values[a + j]) for j in slots}
                        if 2 * len(slots) <= k and seen[p : p + k] == part and len({x[:2] for x in pairs}) == len({x[::2] for x in pairs}) == len(pairs):
                            hits.setdefault(p, []).append((a, own[p : p + k] == values[a : a + k]))
            if hits:
                covered = {a + j for h in hits.values() for a, _ in h for j in range(k)}
                found.append((d, i, len(hits), round(len(covered) / len(values), 9), min(hits), all(any(v for _, v in h) for h in hits.values())))
    return sorted(found)


def test_contaminated_documents_match_brute_force(spark):
    rng = random.Random(17)
    words = ["has", "gives", "the", "apple", "to", "Tom", "Eve", "Rome", "4", "12", "km", "hours", "and", "then.", "Who"]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    items = [(i, text(rng.choice([2, 3, 7, 9, 14]))) for i in range(12)]
    swap = {"Tom": "Ann", "4": "7", "km": "miles", "Rome": "Oslo"}
    docs = []
    for d in range(60):
        parts = [text(rng.randrange(6))]
        for _ in range(rng.randrange(3)):
            item = rng.choice(items)[1]
            parts += [" ".join(swap.get(w, w) for w in item.split()) if rng.random() < 0.5 else item, text(rng.randrange(4))]
        docs.append((d, " ".join(parts)))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=5, least=3).collect()
    want = brute_contaminated(docs, items, 5, 3)
    assert sorted((r.doc_id, r.item_id, r.n_windows, round(r.coverage, 9), r.first_word, r.verbatim) for r in got) == want
    assert any(not w[-1] for w in want) and any(w[-1] for w in want)
    kept = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=5, least=3)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _ in docs} - {w[0] for w in want})


def test_verbatim_items_match_whatever_their_slots_and_case(spark):
    items = ["WHAT IS THE CAPITAL CITY OF THE LARGEST COUNTRY IN SOUTH AMERICA", "The Old Man And The Sea By Ernest Hemingway Was Published In Cuba", "Compute 3 7 9 12 15 18 21 24 27 30", "Who wrote Hamlet in London?", "it is said that Anna met Peter in Rome and then left"]
    bench = spark.createDataFrame([*enumerate(items), (8, "???"), (9, "")], "item_id long, text string")
    rows = [(i, f"Some words before. {t} And some -- after it.") for i, t in enumerate(items)]
    rows += [(10 + i, f"some words before {t.lower()}") for i, t in enumerate(items)]
    rows += [(20, "Compute 4 8 9 12 15 18 21 24 27 31"), (21, "Who wrote Faust in London?"), (22, "-- ... ??? !")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.verbatim, r.coverage) for r in got} == {(i + d, i, True, 1.0) for i in range(5) for d in (0, 10)}
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [20, 21, 22]


def test_decontamination_of_odd_documents(spark):
    docs = odd_documents(spark)
    bench = spark.createDataFrame([(1, "covers this text. The MIT License covers this text. The MIT")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()} == {5}
    assert decontaminate.decontaminate(docs, bench).count() == docs.count() - 1


# --- licenses ---


def test_templates_of_optional_wording_only():
    a = licenses.compile_template("x", "<<optional>>mit<<end>> <<optional>>license<<end>>")
    assert licenses.scan_text(b"the MIT license", {}, [a])[5] == "x" and licenses.scan_text(b"none", {}, [a])[5] == ""


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    starts, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_phrases_match_brute_force(spark):
    rng = random.Random(8)
    parts = ["the", "MIT License", "mit", "license", "apache-license", "Apache License, Version 2.0", "CC-BY 4.0", "cc by", "GNU General Public License", "é", "漢", "2"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(25)))) for i in range(150)]
    docs = odd_documents(spark).select("doc_id", "text", "labels", "n").union(spark.createDataFrame([(100 + i, t, 1, 1) for i, t in rows], "doc_id long, text string, labels int, n int"))
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == docs.count()
    want = sorted(repr((r.doc_id, *brute_base(r.text))) for r in docs.collect())
    assert sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) or not r.base_labels for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    assert licenses.scan_licenses(docs.limit(0)).collect() == []


def test_templates():
    a = licenses.compile_template("x", "start <<optional>>maybe <<optional>>inner<<end>> this<<end>> then <<var:1-3>> end")
    ok = ["start then a end", "start maybe this then a b c end", "start maybe inner this then a end"]
    bad = ["start maybe then a end", "start then end", "start then a b c d end", "start inner this then a end", "start Then"]
    for t in ok + bad:
        words = licenses.words_of(t.encode())
        found = list(a.spans(words, b" " + b" ".join(words) + b" "))
        assert (found == [(0, len(words))]) == (t in ok), t
    with pytest.raises(ValueError):
        licenses.compile_template("x", "a <<optional>>b")
