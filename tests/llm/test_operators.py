"""Each operator against a brute-force version, an exact round trip or held-out labels, with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from metricspark.llm import bpe, chat, quality, surrogates, urls, warc
from metricspark.llm.decontamination import with_leaks
from metricspark.llm.embeddings import range_join
from metricspark.llm.jaccard import choose_bands, jaccard_join
from metricspark.llm.lines import dedup_lines, line_key

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, links string, n_lines string"


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n)]


def near(text, changes, seed):
    r, out = random.Random(seed), text.split()
    for i in r.sample(range(len(out)), changes):
        out[i] = f"changed{seed}x{i}"
    return " ".join(out)


def docs_of(spark, texts):
    """Documents with columns whose names clash with those operators add."""
    rows = [(i, t, f"l{i}", "n") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def components(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_jaccard_join_against_all_pairs(spark):
    base = [" ".join(words(120, s)) for s in range(8)]
    texts = [*base, *(near(b, c, 10 * i + c) for i, b in enumerate(base) for c in (1, 2, 3, 5)), base[0].upper(), base[1]]
    texts += [None, "", "  ,", "two words", "Two, words!", "x " * 300, "x " * 200, base[2] + " " + base[2]]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(docs_of(spark, texts)).collect()}
    tokens = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in tokens]
    linked = [
        (i, j)
        for i in range(len(texts))
        for j in range(i)
        if (tokens[i] == tokens[j] if tokens[i] else (texts[i] or "") == (texts[j] or ""))
        or sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    ]
    least = components(len(texts), linked)
    assert got == {i: (least[i], sum(i in p for p in linked)) for i in range(len(texts))}


def test_bands_reach_their_recall():
    bands, rows = choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999
    assert bands * rows <= 160


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join(docs_of(spark, ["a"]).where("false")).collect() == []


def test_line_dedup_against_a_dictionary(spark):
    long = ["Lines that three hold\tare dropped", "lines that TWO hold are all kept", "É ééééééééééééééééééé É"]
    texts = [
        f"{long[0]}\n{long[1]}\nshort\nshort",
        f" {long[0].upper()} \n{long[2]}\n\n{long[0]}",
        f"{long[0]}\x0b\n{long[1]}\n{long[2]}",
        f"{long[2]} \n{long[2].lower()}",
        f"{long[2]}",
        None, "", "\n", "x" * 100_000,
    ]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in dedup_lines(docs_of(spark, texts), batches=3, fan=2).collect()}
    holders = defaultdict(set)
    split = [(t or "").encode().split(b"\n") for t in texts]
    for i, lines in enumerate(split):
        for line in lines:
            holders[line_key(line, 20)].add(i)
    want = {}
    for i, lines in enumerate(split):
        keys = [line_key(line, 20) for line in lines]
        kept = [x for x, k in zip(lines, keys) if k is None or len(holders[k]) < 3 or max(holders[k]) == i]
        want[i] = (b"\n".join(kept).decode(), len(lines), len(lines) - len(kept))
    assert got == want
    assert sum(w[2] for w in want.values()) >= 4


def test_leaks_with_changed_numbers_names_and_units(spark):
    item = "A farmer called Maria Stone sells 12 boxes of apples at 3.5 dollars each and Maria Stone drives 40 km home"
    other = " ".join(words(30, 99))
    changed = item.replace("Maria Stone", "Joan").replace("12", "1,900").replace("3.5 dollars", "7 euros").replace("40 km", "9 miles")
    uneven = changed.replace("Joan drives", "Petra drives")
    texts = [item, f"Before. {changed} after that", uneven, other[: len(other) // 3], other, None, "", "x " * 5000, item]
    rows = [(7, item), (8, other), (9, None), (None, "three words only")]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    found = with_leaks(docs_of(spark, texts), bench)
    got = {(r.doc_id, r.item): (r.matched, r.changed) for r in found.select("doc_id", F.inline("leaks")).collect()}
    assert set(got) == {(0, 7), (1, 7), (2, 7), (4, 8), (8, 7)}
    assert got[0, 7][1] == 0 and got[1, 7][1] >= 5
    # the window that holds only the odd name does not count
    assert got[2, 7][0] < got[1, 7][0]
    assert with_leaks(docs_of(spark, texts), bench, block_words=10).where("size(leaks) > 0").count() == 5
    assert with_leaks(docs_of(spark, texts), bench.where("false")).where("size(leaks) > 0").count() == 0


def test_leaks_with_changed_names_where_sentences_begin_and_in_one_case(spark):
    item = "Natalia sold 48 clips. Natalia bought 12 pens. Natalia lost 7 coins."
    joan = "Joan sold 30 clips. Joan bought 9 pens. Joan lost 2 coins."
    inside = "The farmer Maria Stone took 3 kg of apples to Maria Stone and then 5 miles back"
    texts = [
        joan, joan.lower(), joan.upper(), f"Some words: {joan}", joan.replace("Joan lost", "Petra lost"), inside.lower(), inside.upper(),
        inside.replace("3 kg", "12kg").replace("Maria Stone", "Joan"), "Joan ran 30 laps. Joan ate 9 pies. Joan won 2 cups.",
    ]
    for given in (item, item.lower()):
        bench = spark.createDataFrame([(1, given), (2, inside)], "item_id long, text string")
        got = {(r.doc_id, r.item): r for r in with_leaks(docs_of(spark, texts), bench).select("doc_id", F.inline("leaks")).collect()}
        assert set(got) == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (6, 2), (7, 2)}
        assert got[4, 1].matched < got[0, 1].matched and got[0, 1].changed == 4


def test_leaks_of_short_items_and_of_runs_in_long_ones(spark):
    short, name = "What is 12 * 7?", "Who was Napoleon?"
    passage = words(200, 5)
    question = "how many boats did the captain see before the storm came in that evening"
    other = words(60, 6)
    texts = [
        " ".join([*other, f". {short}", *other]), short, " ".join([*other[:20], "what is 13 * 7", *other]),
        "So who was napoleon in the end", "So who was Caesar in the end", " ".join([*other, *passage[50:120], *other]),
        " ".join([*other, question, *other]), " ".join([*other, *passage[50:61], *other]),
    ]
    rows = [(1, short), (2, name), (3, " ".join([*passage, question])), (4, "moon")]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    got = {(r.doc_id, r.item) for r in with_leaks(docs_of(spark, [*texts, "The Moon, of course"]), bench).select("doc_id", F.inline("leaks")).collect()}
    assert got == {(0, 1), (1, 1), (3, 2), (5, 3), (6, 3), (8, 4)}


def test_url_rules_and_ranks(spark):
    rules = [("good.com", "/", "allow"), ("bad.net", "/", "block"), ("bad.net", "/fine/", "allow")]
    link = lambda *hosts: "".join(f"<a class=x href='http://{h}/a'>x</a>" for h in hosts)
    rows = [
        (1, "http://www.Good.com/x?q#f", link("friend.org"), "k"), (2, "https://bad.net/a", "", "k"),
        (3, "http://worse.net/", link("bad.net", "also.bad.net"), "k"), (4, "http://friend.org/", "<a href=/self>", "k"),
        (5, "http://bad.net/fine/1", None, "k"), (6, "no scheme", None, "k"), (7, None, None, "k"),
        (8, "http://also.bad.net/z", None, "k"), (8, "http://notbad.net", None, "k"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules).collect() if r.page_id not in (3, 4, 6, 7))
    assert got == [
        (1, "www.good.com", "/x", "good.com/", "allow"), (2, "bad.net", "/a", "bad.net/", "block"),
        (5, "bad.net", "/fine/1", "bad.net/fine/", "allow"), (8, "also.bad.net", "/z", "bad.net/", "block"),
        (8, "notbad.net", "", None, "allow"),
    ]
    rest = {r.page_id: r for r in urls.judge(pages, rules).where("page_id in (3, 4, 6, 7)").collect()}
    assert [rest[i].verdict for i in (3, 4, 6, 7)] == ["block", "allow", "allow", "allow"]
    assert rest[4].trust > 0 and rest[7].host == rest[7].path == ""


def test_rank_against_a_matrix(spark):
    r = np.random.default_rng(3)
    names = [f"h{i}" for i in range(12)]
    pairs = [(a, b, int(r.integers(1, 5))) for a in names for b in names if a != b and r.random() < 0.2]
    edges = spark.createDataFrame(pairs, "src string, dst string, n long")
    seeds = spark.createDataFrame([("h1", 1.0), ("h4", 0.5)], "host string, weight double")
    got = {x.host: x["rank"] for x in urls.personalised_rank(edges, seeds, tolerance=1e-3).collect()}
    p = np.zeros((12, 12))
    for a, b, n in pairs:
        p[names.index(a), names.index(b)] = n
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-9)
    start = np.zeros(12)
    start[[1, 4]] = 1.0, 0.5
    want = np.linalg.solve(np.eye(12) - 0.85 * p.T, 0.15 * start)
    assert all(abs(got.get(n, 0) - w) < 0.01 for n, w in zip(names, want))


def test_archive_round_trip_and_look_up(spark):
    big = "<html>" + "é" * 200
    rows = [(i, f"http://h{i % 5}.example.org/p{i % 7}", big if i % 3 else f"page {i} " * 40, "x") for i in range(60)]
    rows += [(60, None, None, "x"), (61, "", "", "x"), (62, "http://a b\n/", "tiny", "x"), (63, "http://a b\n/", "tiny", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(4)
    archive = warc.write(pages, lines=4)
    assert archive.directory.count() > 10
    got = {r.page: r for r in archive.fetch(archive.look_up(pages)).collect()}
    first = {}
    for i, _, html, _ in rows:
        first.setdefault(html or "", i)
    assert len(got) == len(rows)
    for i, _, html, _ in rows:
        payload = (html or "").encode()
        again = len(payload) >= 100 and first[html] != i
        assert got[i].payload_bytes == len(payload) and got[i].payload_digest == hashlib.sha256(payload).hexdigest()
        assert (got[i].record_type, got[i].refers_to) == (("revisit", first[html]) if again else ("response", None))
        assert again or bytes(got[i].payload) == payload
    one = spark.createDataFrame([("HTTP://H1.EXAMPLE.org/p1",), ("http://nowhere/",)], "url string")
    found = archive.fetch(archive.look_up(one))
    assert {r.page for r in found.collect()} == {i for i in range(60) if i % 5 == 1 and i % 7 == 1}
    empty = warc.write(pages.where("false"))
    assert empty.fetch(empty.look_up(pages)).collect() == []


def test_surrogates_keep_kind_identity_and_form(spark):
    texts = [
        "Mail ann.07@mail.example.com or ANN.07@MAIL.EXAMPLE.COM, +1 (017) 555-7713 is 017-555-7713.",
        "Mr Smith met Mary Jones; Lady Jones met МАРИЯ. Мария Петрова", "4532015112830366 4532-0151-1283-0366 169.1.2.3",
        "kept: 10.5 of 2024, nothing here", None, "", "ann.07@mail.example.com ben.08@mail.example.com", "-" * 50_000,
    ]
    rows = {r.doc_id: r for r in surrogates.replace_pii(docs_of(spark, texts)).collect()}
    out = {i: r.text for i, r in rows.items()}
    assert [out[i] for i in (3, 4, 5, 7)] == [texts[3], "", "", texts[7]] and rows[3].links == "l3"
    low, up, phone, short = re.match(r"Mail (\S+) or (\S+), (\+1 \(\d{3}\) \d{3}-\d{4}) is (\d{3}-\d{3}-\d{4})\.$", out[0]).groups()
    assert low.upper() == up and re.match(r"[a-z]{3}\.\d\d@m\w+\.example\.\w{3}$", low) and "ann" not in low
    assert re.sub(r"\D", "", phone)[1:] == re.sub(r"\D", "", short) != "0175557713"
    one, two = out[6].split()
    assert one == low and two != one and two.split("@")[1] == one.split("@")[1]
    smith, given, jones, again, russian, russian2, _ = re.match(
        r"Mr (\S+) met (\S+) (\S+); Lady (\S+) met (\S+)\. (\S+) (\S+)$", out[1]
    ).groups()
    assert jones == again != "Jones" and smith != jones and given in surrogates.GIVEN["f", "latin"].split()
    assert russian == russian2.upper() and russian2 in surrogates.GIVEN["f", "cyrillic"].split()
    card, grouped, _ = out[2].split()
    digits = [int(c) for c in reversed(card)]
    assert grouped.replace("-", "") == card and card != "4532015112830366" and card[0] == "4"
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def test_surrogates_of_names_that_are_no_surrogates_and_of_surnames_alone(spark):
    texts = [
        "Emma Miller and Peter Schmidt met Carlos Ruiz. Chen Wei came; Chen Wei left.", "Mary Jones spoke. Later Jones left, said JONES.",
        "Ludwig van Beethoven, Mary O'Brien, Emma McDonald and John F. Kennedy", "His name is Xolani Dube. Emma Was late; Mary In town.",
        "New York and the United States stay", "Mary Jones-Smith; Lady Jones",
    ]
    out = {r.doc_id: r.text for r in surrogates.replace_pii(docs_of(spark, texts)).collect()}
    gone = "Emma Miller Peter Schmidt Carlos Ruiz Chen Wei Jones JONES Beethoven Brien McDonald Kennedy Xolani Dube".split()
    assert not [w for w in gone if any(re.search(rf"\b{w}\b", out[i]) for i in out)]
    assert " van " in out[2] and " Was late" in out[3] and " In town" in out[3] and out[4] == texts[4]
    jones, alone, upper = re.match(r"\S+ (\S+) spoke\. Later (\S+) left, said (\S+)\.$", out[1]).groups()
    assert jones == alone and upper == jones.upper()
    one, two = re.search(r"(\S+ \S+) came; (\S+ \S+) left", out[0]).groups()
    assert one == two


def test_surrogates_of_over_long_and_other_shapes(spark):
    r = random.Random(3)
    key = lambda n, alphabet="abcXYZ0189": "".join(r.choice(alphabet) for _ in range(n))
    long = ["".join(r.choice("0123456789abcdef") for _ in range(300)), f"sk-proj-{key(150)}-{key(60)}", f"xoxb-{key(60)}-{key(60)}"]
    long += [f"ghp_{key(80)}", f"{key(90, 'abcd')}.{key(40, 'efgh')}@mail.example.com"]
    shapes = ["2001:db8::8a2e:370:7334", "2001:0DB8:0:0:0:8a2e:0370:7334", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000"]
    shapes += ["GB29 NWBK 6016 1331 9268 19", "030 1234567", "(030) 1234567", "0171/1234567", "020 7946 0958", "01 23 45 67 89", "0301234567"]
    locals_ = ["王小明", "محمد", "דוד", "김철수", "たろう", "ნინო", "ሰላም", "अमित"]
    emails = [f"{x}@mail.example.com" for x in locals_]
    kept = "at 12:30:45 on 01-02-2024 12:30, 01/02/2024, std::vector, a::b, 10.5 and 007"
    found = [*long, *shapes, *emails]
    out = {r.doc_id: r for r in surrogates.replace_pii(docs_of(spark, [*(f"see {x} there" for x in found), kept, "a." * 30_000 + " x@y"])).collect()}
    new = [re.match(r"see (.*) there$", out[i].text).group(1) for i in range(len(found))]
    assert [r.n_entities for i, r in sorted(out.items())] == [1] * len(found) + [0, 0] and out[len(found)].text == kept
    for old, now in zip(found, new):
        assert now != old and (len(now) == len(old) or "@" in old or "::" in old or "DB8" in old)
    for old, now in zip(long[:4], new):
        assert not any(old[i : i + 12] in now for i in range(5, len(old) - 12))
    for old, now in zip(locals_, new[-len(emails) :]):
        assert len(now.split("@")[0]) == len(old) and sum(a == b for a, b in zip(old, now)) < len(old)
    v6, full, spaced, compact, british, short, parted = new[5:12]
    assert v6 == full.lower() and spaced.replace(" ", "") == compact and re.match(r"DE\d\d( \d{4}){4} \d\d$", spaced)
    assert re.match(r"GB\d\d [A-Z]{4}( \d{4}){3} \d\d$", british) and re.sub(r"\D", "", parted) == re.sub(r"\D", "", short)


def test_surrogates_stay_distinct_when_draws_meet(spark):
    # more persons than a gender's names: hyphenated ones must keep them apart
    rows = [("given f latin", n.lower()) for n in surrogates.GIVEN["f", "latin"].split()] + [("ssn", f"{i:03d}") for i in range(300)]
    got = surrogates.assign(spark.createDataFrame(rows, "kind string, normal string")).collect()
    assert len(got) == len(rows) == len({(r.kind, r.surrogate) for r in got})
    assert not {(r.kind, r.surrogate.lower()) for r in got} & set(rows)


def test_quality_on_held_out_labels(spark):
    r = random.Random(5)
    good = [" ".join(words(r.randint(30, 200), i)) + "." for i in range(150)]
    bad = [" ".join(w + "%%" for w in words(r.randint(30, 200), 1000 + i)) for i in range(150)]
    docs = docs_of(spark, [*good, *bad, None, "", "x" * 300_000])
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300) if i % 5] + [(300, None)], "doc_id long, quality int")
    rows = {x.doc_id: x for x in quality.classify(docs, quality.fit(docs, labels)).collect()}
    held = [i for i in range(300) if i % 5 == 0]
    assert len(rows) == 303 and all(0 <= x.score <= 1 for x in rows.values())
    assert sum(rows[i].predicted == int(i < 150) for i in held) >= 0.95 * len(held)
    nothing = quality.fit(docs, labels.where("false"))
    assert quality.classify(docs, nothing).where("score <> 0.5").count() == 0


@pytest.fixture(scope="module")
def fuzz():
    r = random.Random(1)
    parts = [*"ab's'tll'reve  \n\t  é中1२.!?—\U0001f600́'", "<|endoftext|>", "'ll", "'re", " '", " 's"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    return [*texts, "x" * 3000, "!?" * 900, "", " ", "\n\n  ", "<|endoftext|>" * 3, "a b " * 200_000, None]


def test_bpe_equals_the_tokenizers_library(spark, fuzz):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(VOCABULARY)
    docs = docs_of(spark, fuzz)
    tokenizer = bpe.with_lexicon(docs, "text", VOCABULARY)
    ids = docs.withColumn("ids", tokenizer.encode(F.col("text"))).withColumn("back", tokenizer.decode(F.col("ids")))
    got = {r.doc_id: r for r in ids.collect()}
    for i, text in enumerate(fuzz):
        want = known.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == want, repr(text)[:200]
        assert got[i].back == known.decode(want, skip_special_tokens=False)


def test_lexicon_is_minimal_and_numbers_words_in_order():
    listed = sorted({w.encode() for n in range(5) for w in words(400, n)} | {b"a", b"ab", b"abc"})
    automaton = bpe.compile_words(listed)
    ends = np.cumsum([len(w) for w in listed])
    tokens = bpe.Tokens(automaton, {})
    data = np.frombuffer(b"".join(listed), np.uint8)
    assert (tokens.look_up(data, ends - [len(w) for w in listed], ends) == np.arange(len(listed))).all()
    rights = {w[i:] for w in listed for i in range(len(w) + 1)}
    follow = defaultdict(set)
    for w in listed:
        for i in range(len(w) + 1):
            follow[w[:i]].add(w[i:])
    assert len(rights) > len(automaton["final"]) == len({frozenset(v) for v in follow.values()})


def test_chat_round_trip_over_many_blocks(spark):
    tricky = r"<|im_end|><|im_start|>assistant <\|x <\\|y <|endoftext|> < |"
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t} " * (t % 9)) for t in range(3000)]
    rows += [(2, 0, "user", tricky), (2, 1, "assistant", tricky), (3, None, None, None), (None, 0, "assistant", "é中"), (4, 5, "a\nb\\n<|", "x")]
    rows += [(5, 0, "assistant", "same"), (5, 0, "assistant", "same"), (6, 0, "assistant", "long text " * 30_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    chats = chat.Chats(spark, VOCABULARY, block=512)
    blocks = chats.format(frame)
    assert blocks.where("size(ids) > 512 or size(ids) <> size(loss_mask)").isEmpty()
    got = {r.conv_id: r for r in chats.read(blocks).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        told = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_range_join_against_all_pairs(spark):
    r = np.random.default_rng(0)
    n = 700
    base = r.normal(size=(40, 8))
    x = base[r.integers(0, 40, n)] + r.normal(size=(n, 8)) * r.choice([0.05, 0.15, 0.4], size=(n, 1))
    x[100:140], x[5] = x[100], 0
    rows = [v.tolist() for v in x]
    rows[7], rows[9], rows[10], rows[11], rows[12] = None, [], [None] * 8, [1.0, 2.0], [1.0, 2.0]
    rows[8][2] = float("nan")
    frame = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").repartition(5)
    got = {v.vec_id: (v.n_links, v.component_id, v.kept) for v in range_join(frame, cell=60, block=50).collect()}
    good = [i for i in range(n) if rows[i] and None not in rows[i] and np.isfinite(rows[i]).all() and np.any(rows[i])]
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    linked = [
        (i, j) for i in good for j in good
        if j < i and len(rows[i]) == len(rows[j]) and cosine(np.array(rows[i]), np.array(rows[j])) >= 0.9
    ]
    count = defaultdict(int)
    for i, j in linked:
        count[i] += 1
        count[j] += 1
    least = components(n, linked)
    assert got == {i: (count[i], least[i], least[i] == i) for i in range(n)}
    assert range_join(frame.where("false")).collect() == []


def test_pipeline_keeps_clean_documents_and_drops_the_rest(spark):
    import corpus_pipeline

    kept = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = kept.collect()
    assert 100 < len(rows) < 200 and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
