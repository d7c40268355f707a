from linkloom import queries

GUESTS = [
    (1, 'יו"ר, <b> & מנכ"ל', "http://a.invalid/?x=1&y=2"), (2, "Head 7 &amp;", None), (3, None, "ftp://b.invalid"), (4, " ", 'https://c.invalid/"q"'), (5, "Chief", "http://d.invalid"),
]
TEXTS = [(1, "The Mr. איש בא"), (2, "Prof. X\nרץ"), (3, None), (4, "A"), (5, "עם The")]


def test_all_texts_and_guests(spark, tmp_path, rows_of):
    folder = str(tmp_path)
    spark.createDataFrame(GUESTS, "guest_id long, job_title string, reference_link string").write.parquet(f"{folder}/guests.parquet")
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    known = queries.queries()
    shown = [(k, f"{(title or '').strip()} z".strip()) for k, title, _ in GUESTS]
    assert rows_of(known["html_visible_text"](spark, folder)) == shown
    assert rows_of(known["html_links"](spark, folder)) == [(k, link) for k, _, link in GUESTS if link and "http" in link]
    assert rows_of(known["clean_prefix_words"](spark, folder)) == [(1, "איש בא"), (2, "X\nרץ"), (3, None), (4, ""), (5, "עם The")]
