"""Alert documents: each precedence that chooses body, date, number, title and outcome."""

from pyspark.sql import functions as F

from quarrylight.operators import alerts as A

PAGE = "What happened\nA worker was lifting a valve and the sling parted near the hook. What a long day it was for the crew that was on the floor.\nWhat went wrong\nThe sling was worn.\nRecommendations\nCheck slings.\nLife-saving rules: Safe Mechanical Lifting, moon walking and Line of Fire\n" + "The floor was wet and the light was low. " * 6
FILE = "The driller was hit by a tong while the crew was making up a joint and this was seen by the men. " * 4
SPANISH = "El trabajador fue golpeado por la tenaza y se cayó de la plataforma al suelo con los otros que estaban. " * 3
HINDI = "मजदूर सीढ़ी से गिर गया और उसके पैर में चोट आई थी उस समय बारिश हो रही थी"
BOARD = "OISD / SA / 2019-20 / E&P / 7 dated 3.4.2019\nTitle: Fire at the pump house\nLocation: Well site\nLoss/Outcome: Two persons burnt\nTitle: Fire at a pump\nBrief of the incident\nA leak at the flange caught fire while the line was opened by two men who had no permit for it.\n"
COLUMNS = f"k int, title string, date string, reference string, tags array<string>, html_text string, attachments {A.ATTACHMENTS}, prefer_page boolean, marine boolean, board boolean, url string"


def row(k, title=None, date=None, reference=None, tags=None, page=None, files=None, prefer=None, marine=None, board=None):
    return (k, title, date, reference, tags, page, files, prefer, marine, board, "u")


ROWS = [
    row(1, page=PAGE, files=[("a.pdf", FILE)]), row(2, page=PAGE, files=[("a.pdf", FILE)], prefer=True), row(3, page=PAGE, files=[("a.pdf", "short")]), row(4, page="Short page of some words.", files=[("es.pdf", SPANISH), ("x_hindi.pdf", HINDI), ("h_hindi.pdf", "abc"), ("e.pdf", ""), ("n.pdf", None)]),
    row(5, page=BOARD, board=True, title="Given"), row(6, page=BOARD, title="19-04 Given", date="2020-01-02", reference="R1"), row(7, page="tiny"), row(8), row(9, title="Alert 4-19 Finger injury results in LTI", date="2019-05-06", page="A finger was caught by the door. It could have resulted in a fatality for the man."),
    row(10, title="x", page="The man died at once near the derrick, and no more is known of it.", marine=True), row(11, title="Lifeboat drill", page="The hook of the boat let go. Nobody was hurt, a near miss.", marine=True, tags=["Driving", "none"]), row(12, title="Lifeboat drill", page="The hook of the boat let go at sea."),
    row(13, page="What happened: Hand cut.\nWhat went wrong: No guard was there."),
]


def test_precedences(spark):
    got = {r.k: r for r in A.alert_documents(spark.createDataFrame(ROWS, COLUMNS).repartition(3)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 9, 10, 11, 12, 13] and all(r.url == "u" for r in got.values())
    assert [got[k].text_source for k in (1, 2, 3, 4)] == ["attachment", "html", "html", "html"] and got[1].body == FILE.strip() and got[2].attachment_languages == []
    assert got[2].narrative.startswith("A worker was lifting") and got[2].what_went_wrong == "The sling was worn." and got[2].corrective_actions.startswith("Check slings.") and got[2].life_saving_rules == ["Safe Mechanical Lifting", "Line of Fire"] and got[2].rules_unmapped == ["moon walking"]
    assert [(x.file, x.lang) for x in got[4].attachment_languages] == [("es.pdf", "es"), ("x_hindi.pdf", "hi"), ("h_hindi.pdf", "hi")] and got[4].text_hi == HINDI + "\nabc"
    board = got[5]
    assert (board.reference, board.segment, board.year, board.date, board.title, board.location, board.loss_outcome, board.actual_outcome, board.record_type) == ("OISD/SA/2019-20/E&P/07", "exploration_production", 2019, "2019-04-03", "Fire at a pump", "Well site", "Two persons burnt", "injury", "incident")
    assert (got[6].reference, got[6].date, got[6].title, got[6].year) == ("R1", "2020-01-02", "Fire at a pump", 2019)
    assert (got[9].reference, got[9].year, got[9].actual_outcome, got[9].record_type, got[9].actual_fatality) == ("19-04", 2019, "lost_time_injury", "injury", False) and got[9].potential_consequence.startswith("It could have resulted")
    assert (got[10].actual_outcome, got[10].record_type, got[10].off_domain) == ("fatality", "fatal", False)
    assert (got[11].off_domain, got[11].record_type, got[11].actual_injury, got[11].life_saving_rules, got[12].off_domain) == (True, "near_miss", False, ["Driving"], False)
    assert got[13].text == "Hand cut. No guard was there." and got[13].narrative_words == 2
    assert A.alert_documents(spark.createDataFrame(ROWS[:1], COLUMNS).where("false")).collect() == []


def test_languages(spark):
    texts = [(FILE, "en"), (SPANISH, "es"), (HINDI, "hi"), ("short", "other"), (None, "other"), ("12345 " * 20, "other"), ("Yang dan di untuk dengan tidak pada dari ini itu adalah", "id"), ("zzz qqq " * 10, "other"), ("le chat et les chiens dans une maison avec des amis pour la nuit", "fr")]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "k int, t string").select("k", A.text_language(F.col("t")).alias("lang"))
    assert {r.k: r.lang for r in df.collect()} == {k: w for k, (_, w) in enumerate(texts)}
