import unicodedata

from pyspark.sql import functions as F

from courtside.functions import games as g
from courtside.functions import stats as n
from courtside.functions import text as x


def lit(v):
    return F.lit(v)


def test_text_forms(values):
    got = values(
        x.clean_text(lit(" a   b\n")), x.clean_text(lit(" 　 ")), x.slugify(lit("  São Paulo/F.C. ")), x.identity_key(lit("João  D'Ávila 2º")),
        x.norm_name(lit("Zé-Roberto (T) Jr.")), x.title_from_slug(lit("joao-da-silva-2b")),
    )
    assert got == ("a b", None, "sao-paulo-f-c", "joaodavila2o", "ze roberto jr", "Joao Da Silva 2B")


def test_accents_equal_full_decomposition_where_the_base_is_one_letter(values):
    letters = "".join(chr(c) for c in range(0xC0, 0x250) if len(x._folded(chr(c))) <= 1)
    plain, exact = values(x.strip_accents(lit(letters)), x.strip_accents_exact(lit(letters + "ﬁ½")))
    assert plain == "".join(ch for ch in unicodedata.normalize("NFKD", letters) if not unicodedata.combining(ch))
    assert exact == plain + "fi1⁄2"


def test_links(values):
    got = values(
        x.image_key(lit("https://h/a/Logo%20A-150x150.PNG?x=1")), x.team_slug_from_url(lit("https://h/equipes/s%C3%A3o-1/x")),
        x.player_slug_from_url(lit("/atletas/Jo%C3%A3o-B/")), x.abs_url(lit("/a"), "https://h.org/"), x.abs_url(lit("http://o/x"), "https://h.org"),
        x.abs_url(lit("//cdn/x"), "https://h.org"), x.abs_url(lit(" "), "https://h.org"), x.segment_after(lit("https://h/"), "equipes"),
    )
    assert got == ("logo a.png", "são-1", "joao-b", "https://h.org/a", "http://o/x", "https://cdn/x", None, None)


def test_seasons_and_dates(values):
    got = values(x.season_path(lit("2009-10")), x.season_path(lit("1999-00")), x.season_path(lit("2012")), x.season_label(lit(18)),
                 x.iso_date(lit("3/4/2020")), x.iso_date(lit("amanhã")), x.iso_date(lit("31/02/2020")))
    assert got == ("2009-2010", "1999-2000", "2012", "2025-26", "2020-04-03", "amanhã", "2020-02-31")


def test_cells(values):
    made, alone, empty = values(n.parse_made_attempted(lit("12/26 (46,2)")), n.parse_made_attempted(lit("7")), n.parse_made_attempted(lit("-")))
    assert tuple(made) == (12, 26, 46.2) and tuple(alone) == (7, None, None) and tuple(empty) == (None, None, None)
    full, total = values(n.parse_rebounds(lit("7+30 37")), n.parse_rebounds(lit("5")))
    assert tuple(full) == (7, 30, 37) and tuple(total) == (None, None, 5)
    assert values(n.minutes_decimal(lit("36:54")), n.minutes_decimal(lit("10,5")), n.minutes_decimal(lit("x:1")), n.parse_number(lit("-4.00"))) == (36.9, 10.5, None, -4.0)
    assert values(n.to_float(lit(" 10,5 ")), n.to_float(lit("abc")), n.to_int(lit("10.9")), n.to_int_or_null(lit("")), n.to_bool(lit("Sim"))) == (10.5, 0.0, 10, None, True)
    name, starter, size, old = values(x.name_and_jersey(lit("Marcelinho # 4")), x.starter_flag(lit("Alex (T)")), n.height_weight(lit("1,91 / 100kg")), n.height_weight(lit("191")))
    assert tuple(name) == ("Marcelinho", "4") and tuple(starter) == ("Alex", 1) and tuple(size) == (191, 100.0) and tuple(old) == (191, None)


def test_ratios(values):
    none = F.lit(None).cast("bigint")
    assert values(n.game_pct(lit(1), lit(4)), n.game_pct(lit(0), lit(0)), n.game_pct(none, lit(3)), n.season_pct(lit(1), lit(0)), n.per_game(lit(5), lit(0)),
                  n.win_pct(lit(1), lit(0)), n.record_text(lit(3), lit(1))) == (25.0, 0.0, None, None, 0.0, 0.0, "3-1")


def test_stages_and_results(values):
    stage = lambda p, r=None: g.stage_from_game(lit(p), lit(r).cast("string"))
    assert values(stage("Quartas de final"), stage("Semifinal"), stage("FINAL", "Jogo 2"), stage("Oitavas"), stage("1º Turno", "Mata-mata"), stage("Playoffs"), stage("1º Turno"), stage(" ")) == (
        "quartas", "semifinal", "final", "oitavas", "playoffs", "playoffs", None, None)
    assert values(g.winner(lit(1), lit(2), lit(70), lit(80)), g.winner(lit(1), lit(2), lit(70), lit(70)), g.winner(lit(1), lit(2), lit(70), lit(80), lit(1))) == (2, None, 1)
    view, other = values(g.side_and_opponent(lit(2), lit(1), lit(2), lit(70), lit(80)), g.side_and_opponent(lit(9), lit(1), lit(2), lit(70), lit(80)))
    assert tuple(view) == ("away", 1, 80, 70, "W") and tuple(other) == (None,) * 5
    assert values(g.stage_label(lit(-1)), g.stage_label(g.stage_order(lit("final"))), g.stage_order(lit("semifinal"))) == ("em andamento", "vice-campeão", 4)


def test_metric_words(values):
    m = x.metric_from_text
    assert values(m(lit("mais Pontuação na história")), m(lit("vitórias em jogos")), m(lit("minha opinião")), m(lit("jogos e erros"))) == ("points", "wins", None, "turnovers")


def test_display(values):
    c = n.format_cell
    assert values(c(lit("2026-03-01"), "date"), c(lit(0.5), "pct"), c(lit(46.2), "pct"), c(lit(3), "number"), c(lit(3.25), "number"), c(lit(""), "text"),
                  c(lit(None).cast("boolean"), "bool")) == ("01/03/2026", "50.0%", "46.2%", "3", "3.3", "-", "-")
    assert values(n.age(lit("2000-03-02"), lit("2024-03-01")), n.age(lit("2000-03-01"), lit("2024-03-01"))) == (23, 24)


def test_cells_without_a_match_cast_no_empty_text(spark):
    """A failed cast raises and catches an error per row, so a cell that does not match must be NULL before its cast."""
    cells = spark.createDataFrame([("36:54",), ("36,5",), (" ",), (None,), ("1:2:3",), (":30",), ("a",), ("12/26 (46,2)",), ("7+30 37",), ("-4",)], "c string")
    read = cells.select("c", n.minutes_decimal("c").alias("m"), n.parse_made_attempted("c").alias("s"), n.parse_rebounds("c").alias("r"))
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract(" not in plan and "CASE WHEN (trim" not in plan
    got = {x.c: (x.m, tuple(x.s), tuple(x.r)) for x in read.collect()}
    none = (None, None, None)
    assert got == {
        "36:54": (36.9, (36.0, None, None), (None, None, 36)), "36,5": (36.5, (36.5, None, None), (None, None, 36)), " ": (None, none, none), None: (None, none, none),
        "1:2:3": (None, (1.0, None, None), (None, None, 1)), ":30": (None, (30.0, None, None), (None, None, 30)), "a": (None, none, none),
        "12/26 (46,2)": (None, (12.0, 26.0, 46.2), (None, None, 12)), "7+30 37": (None, (7.0, None, None), (7, 30, 37)), "-4": (-4.0, (-4.0, None, None), (None, None, -4)),
    }
