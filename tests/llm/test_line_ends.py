from linkloom.llm import sentences


def _units(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [r["sentence"] for r in sentences.sentence_units(df, "doc_id", "text").orderBy("pos").collect()]


def test_a_long_last_line_doesnt_cut_the_broken_ones(spark):
    first = "אחד מחברי הועדה הגיש בקשה\nנוספת ולא אמר יותר."
    last = ["הגזבר " + "הזכיר את ההסכם " * 6 + "אתמול.", "דובר החברה ביקש דחייה " * 3 + "היום."]
    assert _units(spark, f"{first} {' '.join(last)}") == [first, *last]


def test_no_cut_within_brackets_and_quotations(spark):
    units = ["Chair X Y:", "The clerk (formerly of X\nTextiles) spoke.", 'He wrote: "It is late.\nVery late." Then he left.']
    assert _units(spark, "\n".join(units)) == units
    items = ["List:", "* one (see", "* two) three"]
    assert _units(spark, "\n".join(items)) == items


def test_a_title_in_a_text_of_short_lines(spark):
    units = ["某某集团再次出席委员会", "财务主管支持草案。", "没有人来。"]
    assert _units(spark, "\n".join(units)) == units


def test_quotations_and_brackets_of_any_length(spark):
    said = "The panel met. It left. " * 100
    for opener, closer in ('""', "“”", "«»", "()"):
        units = [f"He wrote {opener}{said.strip()}{closer} and left.", "Then it rained."]
        assert _units(spark, " ".join(units)) == units


def test_thai_lists_names_and_years(spark):
    units = ["รายการนี้ประกอบด้วยบ้าน สวน ฯลฯ เท่านั้น", "ดร. โลนิดู เดินออกจากห้อง", "เขาอ้างถึงข้อตกลงปี 2009", "มีผู้เข้าร่วม 1500 คน"]
    assert _units(spark, " ".join(units)) == units
