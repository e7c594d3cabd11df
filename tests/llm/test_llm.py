"""Text operators against other implementations, round trips and brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakesmith.llm import bpe, packing, residue

from tests.conftest import rows_of

tokenizers = pytest.importorskip("tokenizers")

DOCS = "doc_id bigint, text string, k string, t string, ids string, tokens string"


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(bpe.vocabulary("byte_bpe_50k"))


@pytest.fixture(scope="module")
def other():
    t = tokenizers.Tokenizer.from_file(f"{bpe.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


ALPHABETS = ("a", "ab", " ", " \n\t\r", "é漢字😀  ​", "x<|endoftext|> ", "The quick brown fox's 12,345 — 'll 've", "\x00\x01\x7f﻿")


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_ids_equal_another_implementation(encoder, other, alphabet):
    rng = random.Random(alphabet)
    for n in (0, 1, 2, 3, 7, 50, 1000):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        assert encoder.encode(text) == other(text)


def test_very_long_pieces_are_merged_whole(encoder, other):
    for text in ("a" * 300_000, "ab" * 50_000 + " " * 100_000, "漢" * 30_000):
        assert encoder.encode(text) == other(text)


def brute_merge(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_segment_tree_equals_brute_force_on_made_up_vocabularies():
    rng = random.Random(1)
    for _ in range(300):
        letters = [bytes([c]) for c in b"abc"]
        tokens = letters + list({b"".join(rng.choice(letters) for _ in range(rng.randrange(2, 6))) for _ in range(12)})
        order = tokens[3:]
        rng.shuffle(order)
        ranks = {t: i for i, t in enumerate(letters + order)}
        piece = b"".join(rng.choice(letters) for _ in range(rng.randrange(1, 40)))
        got = bpe.Encoder(ranks).merge(piece)
        assert got == ([ranks[piece]] if piece in ranks else brute_merge(piece, ranks))


def test_corpus_keeps_every_row(spark, table, other):
    docs = table(DOCS, [(1, "Hello world", "", "", "", ""), (2, "", "", "", "", ""), (3, None, "", "", "", ""), (4, "  \n", "", "", "", ""), (None, "x", "", "", "", ""), (1, "again", "", "", "", "")])
    got = {(r["doc_id"], tuple(r["ids"])) for r in bpe.encode_corpus(docs).collect()}
    assert got == {(1, tuple(other("Hello world"))), (2, ()), (3, ()), (4, tuple(other("  \n"))), (None, tuple(other("x"))), (1, tuple(other("again")))}
    assert rows_of(bpe.token_counts(docs), "tokens") == sorted(((len(i),) for _, i in got), key=str)
    assert bpe.encode_corpus(docs.limit(0)).columns == ["doc_id", "ids"] and bpe.encode_corpus(docs.limit(0)).count() == 0


def test_long_results_leave_in_several_batches(spark, monkeypatch, table):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20).alias("text"))
    monkeypatch.setattr(bpe, "BATCH_IDS", 100)
    assert bpe.encode_corpus(docs).select("doc_id").distinct().count() == 300


# Packing


def brute_best_fit(sizes, capacity):
    rooms, placed = [], []
    for s in sizes:
        fits = [r for r in rooms if r >= s]
        if fits:
            room = min(fits)
            rooms.remove(room)
        else:
            room = capacity
            placed.append(None)
        rooms.append(room - s)
    return len(placed), sorted(r for r in rooms if r)


@pytest.mark.parametrize("capacity", [1, 7, 64, 100, 2048])
def test_best_fit_equals_brute_force(capacity):
    rng = random.Random(capacity)
    for n in (0, 1, 5, 200):
        sizes = sorted((rng.randint(1, capacity) for _ in range(n)), reverse=True)
        placed, bins = packing.best_fit(sizes, capacity)
        fill = Counter()
        for size, number in zip(sizes, placed, strict=True):
            fill[number] += size
        assert (bins, sorted(capacity - f for f in fill.values() if f < capacity)) == brute_best_fit(sizes, capacity)


def test_open_bins_give_the_tightest():
    bins = packing.OpenBins(10)
    for number, room in enumerate((3, 9, 5, 5)):
        bins.add(room, number)
    assert bins.take(4) == (5, 3) and bins.take(4) == (5, 2) and bins.take(4) == (9, 1) and bins.take(4) is None and bins.take(3) == (3, 0)


def test_packing_loses_nothing_and_cuts_only_what_is_too_large(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice((0, 1, 5, 30, 99, 100, 101, 250, 1000))) for i in range(500)] + [(None, 7), (3, 8), (501, None)]
    for group_items in (10_000, 60):
        packed = packing.pack(spark.createDataFrame(rows, "doc_id bigint, tokens int"), 100, len(rows), group_items=group_items).collect()
        per_bin, per_doc = Counter(), Counter()
        for r in packed:
            per_bin[r["container_id"]] += r["tokens"]
            per_doc[r["doc_id"]] += r["tokens"]
        assert max(per_bin.values()) <= 100
        wanted = Counter()
        for k, n in rows:
            wanted[k] += n or 0
        assert per_doc == +wanted
        whole = [r for r in packed if r["first"] == 0 and r["piece"] == 0]
        assert all(r["piece"] == 0 for r in packed if dict(rows[:500]).get(r["doc_id"], 0) <= 100) and len(whole) == sum(1 for _, n in rows if n)
        total = sum(wanted.values())
        assert len(per_bin) <= -(-total // 100) + 20 + 5 * (len(rows) // group_items)
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, tokens int"), 100, 0).count() == 0


def test_repeated_keys_spread_and_ids_do_not_depend_on_row_order(spark):
    rows = [(None, 7)] * 2000 + [(1, 7)] * 500 + [(2, 950)] * 3 + [(3, 100_000)]
    counts = spark.createDataFrame(rows, "doc_id bigint, tokens int")
    expected = packing.piece_count(counts, 100)
    assert expected == 2000 + 500 + 30 + 1000
    packed = packing.pack(counts, 100, expected, group_items=200)
    sizes = packed.groupBy(F.shiftright("container_id", 40).alias("g")).count().collect()
    assert len(sizes) == 18 and max(r["count"] for r in sizes) < 300
    again = packing.pack(spark.createDataFrame(rows[::-1], counts.schema).repartition(7), 100, expected, group_items=200)
    assert rows_of(packed) == rows_of(again)
    assert packed.groupBy("container_id").agg(F.sum("tokens").alias("n")).agg(F.max("n")).first()[0] == 100


def test_a_third_of_all_rows_of_one_size(spark):
    sizes = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 700).otherwise(F.col("id") % 500 + 1).cast("int").alias("tokens"))
    packed = packing.pack(sizes, 2048, 9000, group_items=1000).groupBy("container_id").agg(F.sum("tokens").alias("n"))
    row = packed.agg(F.max("n"), F.avg("n"), F.count("*")).first()
    assert row[0] <= 2048 and row[1] > 2048 * 0.98


# Residue

CASES = [
    "Hi {{ name }},\n\n${body}\n\nRegards\n%%SIGNATURE%%", "<h1>__TITLE__</h1>\n<div class=\"post\">[BODY]</div>", "Title: <%= title %>\nTags: #{tag}", "%(date)s\n\n© board 2013", "{0}",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.", "xxxxxxxxxxxxxxxxxxxxxxxxxx", "asdf asdf qwer test foo bar", "1. Item 1\n2. Item 2\n3. Item 3", "Hier steht später der Text der Antwort.", "Body coming soon ...", "Answer to follow.", "Inhalt (empty)", "Error 1035\nThe origin did not answer in time.\nRay 15247e38", "We are sorry! this post does not exist. Error id 28bd404c.", "Copy final copy more copy until copy final here more copy sentence.",
    "404 Not Found\n\nserver/1.2", "<html><head><title>502 Bad Gateway</title></head><body><h1>502 Bad Gateway</h1></body></html>", "HTTP/1.1 503 Service Unavailable\nServer: x/1.0\nContent-Length: 0", "Access denied. You don't have permission to view /a on this server.",
    "Your session has expired. Log in again to continue.", "This board is down for maintenance. We expect to be back by 06:00 UTC.", "Страница не найдена.", "Página não encontrada. O tópico foi removido.", "ページが見つかりません。",
    "This page needs JavaScript. Turn it on in your browser and reload.", "Bitte JavaScript einschalten, um diese Seite zu sehen.", "Veuillez autoriser les scripts pour afficher cette page.\n\nRef 44579070", "このページを表示するには JavaScript を有効にしてください。",
    "One moment, we are checking your browser before letting you in.", "THIS SITE REQUIRES COOKIES.", "some board\nHome | Questions | Tags | Users\n\n<div id=\"post-1\">Para ver esta página habilite JavaScript.</div>", "`{{ name }}`\n`${body}`", "{% block content %}\n{% include \"row.html\" %}\n{% endblock %}",
]
OTHERS = [
    None, "", "   \n", "No.", "Thanks, that did it!", "+1", "Write `<%= lock %>` instead.", "How do I keep a literal {{ flush }} in a template? The engine replaces it even inside a code block, and doubling the braces prints four of them.",
    "A 404 from the proxy means the report is gone, not the server.", "Every request ends like this:\n\n```\n404 Not Found\n```\n\nI only see it under load; the other host answers normally, so what is different here?", "The TODO in the parser is harmless.",
    "My crawler only gets the line 'This page needs JavaScript' instead of the table. How do I make it wait until it has been drawn?", "It's the login form.", "Is there a generator for filler text? I need 500 words of dummy copy to test long paragraphs.",
    "Set the limit to 20 and measure again before you touch anything else.", "Das ist kein Fehler, sondern so gewollt.", "Home | Questions | Tags", "Es steht in der Dokumentation, dass man den Schlüssel vorher setzen muss.",
]


@pytest.mark.parametrize("text", CASES)
def test_cases_are_found(text):
    assert residue.is_residue(text)
    assert residue.is_residue(f"{text}\n{text}")


@pytest.mark.parametrize("text", OTHERS)
def test_posts_are_no_cases(text):
    assert not residue.is_residue(text)


@pytest.mark.parametrize("text", CASES)
def test_a_post_that_quotes_a_case_is_none(text):
    quoted = "\n".join(f"    {line}" for line in text.split("\n"))
    post = f"The saved pages of our old board all look like this:\n\n{quoted}\n\nWhich setting of the archive makes it store the real thread? I've tried two of them with a larger buffer."
    assert not residue.is_residue(post)


# Posts that name what the phrases name, and pages in languages that the test tables do not have.
POSTS = [
    "Internal server error here is caused by a missing migration, run migrate.", "The server is busy because the loop never yields to the scheduler thread.", "Clear the cache and please try again.", "You need cookies for this to work.",
    "Fixed in version 2.3, will follow up.", "${HOME}/bin must be on PATH", "Use {{ user.name }} in your template", "Use $1 and {0}.", "The quick brown fox test string is used in fonts.", "Use a placeholder.", "Easy to follow.",
    "Try restarting nginx after changing config files then check logs again", "Please log in again, that fixed it for me.", "You must be logged in as root to run this.", "Turn on JavaScript in the webview settings and it works.", "Set {{ x }} to 3.", "Make the content empty first.",
    "It needs JavaScript, so curl will not do.", "Not found", "404", "The page does not exist until the build has run once.",
]
PAGES = [
    "Pagina non trovata. Torna alla home.", "Per visualizzare questa pagina abilita JavaScript nel tuo browser.", "Strona nie została znaleziona.", "Aby wyświetlić tę stronę, włącz JavaScript w przeglądarce.", "Sayfa bulunamadı.",
    "Bu sayfayı görüntülemek için JavaScript gereklidir.", "Pagina niet gevonden.", "Schakel JavaScript in om deze pagina te bekijken.", "Sidan kunde inte hittas.", "Aktivera JavaScript i din webbläsare för att visa sidan.", "الصفحة غير موجودة",
    "يرجى تفعيل JavaScript في متصفحك لعرض هذه الصفحة", "Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.", "lorem sit amet, paragraph dolor incididunt. consequat paragraph.",
]


@pytest.mark.parametrize("text", POSTS)
def test_posts_that_name_phrases_stay(text):
    assert not residue.is_residue(text)


@pytest.mark.parametrize("text", PAGES)
def test_pages_in_other_languages_are_found(text):
    assert residue.is_residue(text)


def test_the_share_is_over_the_whole_document():
    notice, own = "This page needs JavaScript. ", "The scheduler reads its limit once. "
    shares = [residue.coverage(notice * 3 + own * n) for n in range(6)]
    assert shares[0] == 1 and all(a >= b for a, b in zip(shares, shares[1:], strict=False)) and shares[-1] < residue.COVERAGE


def test_the_automaton_equals_a_search_for_each_pattern():
    rng = random.Random(6)
    patterns = dict(residue.automaton().items())
    for text in CASES + [t for t in OTHERS if t] + PAGES + rng.sample(sorted(patterns), 60):
        words = residue._words(text)
        found = sorted((last + 1 - size, last + 1) for last, (size, _) in residue.automaton().iter(words))
        assert found == sorted((i, i + len(p)) for p in patterns for i in range(len(words)) if words.startswith(p, i))


WRAPS = ('<div id="post-1">{}</div>', "<p>{}</p>", "# {}", "> {}", '<div id="post-1"><p>{}</p></div>')


@pytest.mark.parametrize("text", ["Description to follow", "Answer (empty)", "Error 1035", "foo/bar/baz/qux", '["YOUR NAME"]'])
def test_short_cases_are_found_inside_tags_and_bullets(text):
    assert residue.is_residue(text)
    assert [w for w in WRAPS[:3] if not residue.is_residue(w.format(text))] == []


def test_very_long_texts_take_time_in_proportion():
    import time

    for piece in ("a", "a-", "x.y", "${x}a", "key=${x} ", "{{", "<%", "a b ", "home | ", "'it ", "%%", "[A", "0f-", "answer ", "<!--", "<code>", "<code ", "<pre></code>", "```\n"):
        began = time.process_time()
        residue.coverage(piece * 200_000)
        assert time.process_time() - began < 10, piece


def test_very_long_texts_are_read_whole():
    own = "The scheduler reads its limit once, at start; changing it later has no effect. "
    assert not residue.is_residue(own * 20_000 + "404 Not Found")
    assert residue.is_residue("This page needs JavaScript. Turn it on in your browser and reload.\n" * 5_000)


def test_corpus_is_split_in_two(table):
    docs = table(DOCS + ", __is_residue string, is_residue string", [(i, t, "", "", "", "", "x", "y") for i, t in enumerate(CASES[:5] + OTHERS[:5])] + [(None, "x", *[""] * 6), (1, "post", *[""] * 6)])
    flagged = residue.measure(docs)
    assert flagged.count() == docs.count() and rows_of(flagged.filter("is_residue"), "doc_id") == [(i,) for i in range(5)]
    clean = residue.clean_corpus(docs.drop("__is_residue"))
    assert clean.count() == docs.count() - 5 and clean.columns == [c for c in docs.columns if c != "__is_residue"]
    assert residue.measure(docs.limit(0)).count() == 0
