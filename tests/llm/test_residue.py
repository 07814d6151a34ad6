"""Template residue: messages, fillers, slots, and texts that only speak of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mnemospark.llm import residue as R

CONTENT = "The user prefers short answers when working on lantern, and the summary of Monday was kept because two sessions agreed."

CASES = [
    "503 SERVICE UNAVAILABLE\nTHE PAGE HAS BEEN MOVED OR DELETED.\nRETRY AFTER 81 SECONDS.", "Please enable JavaScript to run this app. Otherwise the viewer stays empty.",
    "Home | Notes | Help\n\nAccess denied. You do not have permission to open this notebook.", "Seite nicht gefunden (Fehler 404). Bitte prüfen Sie die Adresse.",
    "请启用 JavaScript 后再查看此页面。", "JavaScriptを有効にしてください。", "Cette page a besoin de scripts pour fonctionner.", "Esta página necesita scripts; actívelos y recargue.",
    "Traceback (most recent call last):\n  File \"export.py\", line 3, in render\n    body = fetch(note)\nConnectionResetError: peer closed", '{"ok": false, "status": 404, "detail": "not found"}',
    "<html><head><title>502 Bad Gateway</title></head><body><h1>Bad Gateway</h1><hr>gateway/1.8</body></html>", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.",
    "TBD\nTBD\nTBD\nTBD", "此处填写内容。此处填写摘要。", "Hier steht später der Text. Dies ist nur ein Blindtext ohne Inhalt.", "[Friday] Allow scripts and reload.\n-- end of export --",
    "Session digest\n\nYour session has expired. Please sign in again to see this note.", "Placeholder text for the summary. Replace this paragraph with the real summary.",
    f"{CONTENT} Thank you, {{{{user_name}}}}! We have stored tea for you.", "Reminder: [INSERT city] leaves for ferryman.", "Hallo %USER_NAME%, dein Projekt tidepool wartet.",
    "Recuerda que ________ viaja el lunes.", "La note de undefined porte sur le thé.", "Merged [object Object] anchors after the last cycle.", "Belief card: <FIRST_NAME> lives in Pellmoor.", "Die Sitzung mit {topic} behandelte Tee.",
]
NO_CASES = [
    None, "", "  \n", CONTENT, "A 503 from the embedding provider is retried 4 times before the belief log gives up.", "Wexa asked why the dashboard wants visitors to enable JavaScript, and we agreed to serve plain pages as well.",
    "The schema template has the slots {topic} and {context}, and each instance fills both of them.", "Mustache braces such as {{topic}} are filled at write time, which the tests check.",
    "Their config sets `store: ${HOME}/memory` and it worked on Sunday.", "We replaced the lorem ipsum in the tidepool demo with real notes from Lisquay.", "A page not found in the archive isn't lost, it sleeps in the cold tier.",
    "When access is denied, the time spine logs the reason and moves on, so Wexa wasn't blocked for long.", 'The review says "placeholder" is a poor name for the time spine; Wexa suggested "stub".',
    f"{CONTENT}\n\n```html\n<p class=\"x\">{{{{ edge.text }}}}</p>\n<noscript>scripts are off</noscript>\n```\n", "The sets {a, b} and {b, c} overlap in one anchor.", "Press [Insert] and then <Enter> to add a cluster.",
    "TODO for Monday: compare the write gate with the cortex router and write the summary for Rildo.", "Scripts on or off? Drosk says the timeline of quillwork now works without them.", "Undefined behaviour of the edge budget was discussed.",
    "The word count limit is 100%, and %s in the old log format stands for the belief id.", "<|endoftext|> was typed by the user.", "用户问为什么 404 页面会出现,Wexa解释说链接已经更新。", f"{CONTENT} aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
]


def table(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, source, "x", "y") for i, t in enumerate(texts)], "doc_id bigint, text string, source string, host string, reason string")


def test_cases_are_found_and_talk_about_them_is_not(spark):
    df = table(spark, CASES + NO_CASES)
    assert {r.doc_id for r in R.judged(df).collect()} == set(range(len(CASES)))
    kept = R.kept(df)
    assert kept.count() == len(NO_CASES) and kept.columns == df.columns


@pytest.mark.parametrize("text", CASES[-8:])
def test_slots(text):
    assert R.has_slot(text)


def test_recurrent_lines_of_a_host_are_subtracted(spark):
    nav = "Timeline view with every anchor, edge and ghost of this store, newest first, oldest last"
    page = f"{nav}\n\nAccess denied.\n\n{nav.upper()} once more"
    # alone the long line is unexplained text; where the host repeats it, it is boilerplate
    assert R.judged(table(spark, [page])).count() == 0
    many = [f"{nav}\n{CONTENT} {i}" for i in range(6)] + [f"{nav.upper()} once more\n{CONTENT}{i}" for i in range(6)]
    assert [r.doc_id for r in R.judged(table(spark, [page, *many])).collect()] == [0]
    # another host's lines do not count
    both = table(spark, [page], "t").unionByName(table(spark, [CONTENT, *many]).filter("doc_id > 0"))
    assert R.judged(both).count() == 0


def test_verdict_does_not_depend_on_the_size_of_the_corpus(spark):
    nav = "Timeline view with every anchor, edge and ghost of this store, newest first, oldest last"
    sound = "That contradiction was kept on purpose, because both of the sessions had good reasons for their own answer"
    # a sound text with one sentence of an error, and an error page with boilerplate only
    texts = [f"{sound}\n\nAccess denied.", f"{nav}\n\nAccess denied. Please sign in."]
    few = table(spark, texts + [f"{nav}\n{CONTENT} {'abcdefghij'[i]}" for i in range(8)] + [f"{CONTENT} {'uvwxy'[i]}" for i in range(5)])
    assert [r.doc_id for r in R.judged(few).collect()] == [1]
    # copies count once
    copies = few.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).drop("k")
    assert [r.doc_id for r in R.judged(copies).collect()] == [1]
    # in an enlarged corpus a sentence that five of many texts share is content
    more = [f"{nav}\n{CONTENT} {i}x" for i in range(200)] + [f"{CONTENT} {i}y" for i in range(400)] + [f"{sound}\n{CONTENT} {i}z" for i in range(6)]
    large = few.unionByName(table(spark, more).withColumn("doc_id", F.col("doc_id") + 1000))
    assert [r.doc_id for r in R.judged(large).collect()] == [1]


def test_repeated_rows_nulls_and_empty_tables(spark):
    df = table(spark, CASES[:2], None)
    assert sorted(r.doc_id for r in R.judged(df.union(df)).collect()) == [0, 1]
    assert R.judged(df.limit(0)).count() == 0 and R.kept(df.limit(0)).count() == 0


def test_long_texts(spark):
    long = (CONTENT + " ") * 3000
    df = table(spark, [long, long + " {{slot}} ends it.", "Lorem ipsum dolor amet. " * 4000])
    assert sorted(r.doc_id for r in R.judged(df).collect()) == [1, 2]


@pytest.mark.parametrize("start", ["", "sample ", "the ", "{{", "${", "<%", "@@", "%", "[[", "<A", "__", "at ", "error", "oops", "lorem ipsum ", "<error ", "todo: ", "access to ", "<code>", "this site "])
def test_very_long_tokens_are_read_in_linear_time(start):
    import time

    for fill in ("a", "☺", "a ", "a.", "A_", "<ABC> ", "{x} ", "[Xy] ", "<code>", "if ", ". ", "sample "):
        text = start + (fill * 100_000)[:100_000] + "☺"
        began = time.perf_counter()
        R.verdict(text.splitlines(), [False] * len(text.splitlines()))
        assert time.perf_counter() - began < 1.0


def test_boilerplate_is_subtracted_before_evidence_is_read():
    lines = ["Home | Notes | " + "every anchor of this store " * 9, "```", "Access denied.", "{{name}} is away", "```"]
    assert R.residual(lines, [True] * 5) == ["```", "Access denied.", "{{name}} is away", "```"]
    # without the subtraction the first line is content
    assert R.verdict([CONTENT, "Access denied."], [True, False]) == "error" and R.verdict([CONTENT, "Access denied."], [False, False]) is None


def test_kept_decides_row_by_row_and_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, CONTENT, "s", 1, "l"), (1, "Access denied.", "s", 2, "k"), (2, None, None, 3, None)], "doc_id bigint, text string, source string, host int, lines string")
    got = R.kept(df)
    assert got.columns == df.columns and sorted((r.doc_id, r.host) for r in got.collect()) == [(1, 1), (2, 3)]
