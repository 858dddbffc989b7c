"""Scalar functions over whole columns of the given tables."""

from pyspark.sql import functions as F

from ..functions import games as g
from ..functions import stats as n
from ..functions import text as x
from ..sources import catalog
from ..constants import PLAYER_METRICS
from .bindings import add_view, sql
from .registry import query

# SQL forms of the text functions
WS = r"'[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'"


def s_clean(c):
    return f"nullif(trim(regexp_replace({c}, {WS}, ' ', 'g')), '')"


def s_fold(c):
    return f"strip_accents(lower({s_clean(c)}))"


def s_slug(c):
    return f"nullif(trim(regexp_replace({s_fold(c)}, '[^a-z0-9]+', '-', 'g'), '-'), '')"


def s_key(c):
    return rf"nullif(regexp_replace({s_fold(c)}, '[^\p{{L}}\p{{N}}]+', '', 'g'), '')"


def s_norm(c):
    folded = s_fold(f"replace({c}, '(T)', '')")
    return f"nullif(trim(regexp_replace({folded}, '[^a-z0-9]+', ' ', 'g')), '')"


def s_title(c):
    run = r"regexp_extract_all(replace({c}, '-', ' '), '\p{{L}}+|\P{{L}}+')".format(c=c)
    return s_clean(f"array_to_string(list_transform({run}, lambda w: upper(w[1]) || lower(w[2:])), '')")


def s_path(c):
    return rf"regexp_extract({c}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


DOCS = "documents"


@query("clean_text", f"SELECT doc_id, {s_clean('text')} AS cleaned FROM documents")
def _(t):
    return t.raw(DOCS).select("doc_id", x.clean_text("text").alias("cleaned"))


@query("strip_accents", "SELECT doc_id, strip_accents(text) AS plain FROM documents")
def _(t):
    return t.raw(DOCS).select("doc_id", x.strip_accents("text").alias("plain"))


@query("slugify", f"SELECT doc_id, {s_slug('text')} AS slug FROM documents")
def _(t):
    return t.raw(DOCS).select("doc_id", x.slugify("text").alias("slug"))


@query("identity_key", f"SELECT doc_id, {s_key('text')} AS identity FROM documents")
def _(t):
    return t.raw(DOCS).select("doc_id", x.identity_key("text").alias("identity"))


@query("norm_name", f"SELECT doc_id, {s_norm('text')} AS name FROM documents")
def _(t):
    return t.raw(DOCS).select("doc_id", x.norm_name("text").alias("name"))


@query("title_from_slug", f"SELECT doc_id, {s_title(s_slug('text'))} AS title FROM documents")
def _(t):
    return t.raw(DOCS).select("doc_id", x.title_from_slug(x.slugify("text")).alias("title"))


IMAGE = "'https://cdn.example.org/up/Logo%20' || cast(page_id as string) || '-150x' || cast(page_id as string) || '.PNG?v=1'"


def _s_image(c):
    return rf"nullif(regexp_replace(lower(split_part(url_decode({s_path(c)}), '/', -1)), '-\d+x\d+(\.[a-z0-9]+)$', '\1'), '')"


@query("image_key", f"SELECT page_id, {_s_image(IMAGE)} AS image, {_s_image('url')} AS page FROM pages")
def _(t):
    return t.raw("pages").select(
        "page_id", x.image_key(F.expr(IMAGE)).alias("image"), x.image_key("url").alias("page"))


TEAM_URL = "'https://example.org/equipes/Time%20' || cast(page_id as string) || '/elenco'"
PLAYER_URL = "'https://example.org/atletas/Jos%C3%A9-' || cast(page_id as string) || '/'"


@query("slug_from_url", "SELECT page_id, 'Time ' || cast(page_id as string) AS team, 'jose-' || cast(page_id as string) AS player,"
       r" nullif(regexp_extract(url, '^[^?#]*/en/([^/?#]+)', 1), '') AS page FROM pages")
def _(t):
    return t.raw("pages").select(
        "page_id", x.team_slug_from_url(F.expr(TEAM_URL)).alias("team"),
        x.player_slug_from_url(F.expr(PLAYER_URL)).alias("player"), x.segment_after("url", "en").alias("page"))


@query("abs_url", "SELECT page_id, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href"
       " WHEN href LIKE '//%' THEN 'https:' || href WHEN regexp_matches(href, '^[/?#]') THEN 'https://example.org' || href"
       " ELSE 'https://example.org/' || href END AS link FROM (SELECT page_id,"
       " nullif(trim(unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))), '') AS href FROM pages)")
def _(t):
    links = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return t.raw("pages").select("page_id", links.alias("href")).select(
        "page_id", x.abs_url("href", "https://example.org").alias("link"))


YEAR = "cast(year(o_orderdate) as bigint)"


@query("season_path", f"SELECT o_orderkey, cast({YEAR} as string) || '-' || cast({YEAR} + 1 as string) AS path FROM orders")
def _(t):
    short = F.expr(f"cast({YEAR} as string) || '-' || substr(cast({YEAR} + 1 as string), 3, 2)")
    return t.raw("orders").select("o_orderkey", x.season_path(short).alias("path"))


@query("season_label", f"SELECT o_orderkey, cast({YEAR} as string) || '-' || substr(cast({YEAR} + 1 as string), 3, 2) AS label FROM orders")
def _(t):
    return t.raw("orders").select("o_orderkey", x.season_label(F.expr(f"{YEAR} - 1991"), 1992).alias("label"))


DMY = "cast(day(o_orderdate) as string) || '/' || cast(month(o_orderdate) as string) || '/' || cast(year(o_orderdate) as string)"


@query("iso_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, o_orderpriority AS other FROM orders")
def _(t):
    return t.raw("orders").select(
        "o_orderkey", x.iso_date(F.expr(DMY)).alias("iso"), x.iso_date("o_orderpriority").alias("other"))


# --- cells written from the lines, then read back ------------------------------------------

KEYS = "game_id, line_no, part_id, player_id"
KEY_LIST = ["game_id", "line_no", "part_id", "player_id"]


@query("parse_made_attempted", sql("b_stats",
       f"SELECT {KEYS}, cast(two_made as double) AS made, cast(two_attempted as double) AS attempted, points + 0.5::double AS pct,"
       " cast(points as double) AS lone FROM b_stats"))
def _(t):
    cell = F.expr("two_made || '/' || two_attempted || ' (' || points || ',5)'")
    lone = F.expr("' ' || points || ' pts'")
    return t.stats.select(*KEY_LIST, x.col(n.parse_made_attempted(cell)).alias("v"), n.parse_made_attempted(lone).alias("w")) \
        .select(*KEY_LIST, "v.made", "v.attempted", "v.pct", F.col("w.made").alias("lone"))


@query("parse_rebounds", sql("b_stats",
       f"SELECT {KEYS}, offensive_rebounds AS offensive, defensive_rebounds AS defensive, total_rebounds AS total, plus_minus AS lone FROM b_stats"))
def _(t):
    cell = F.expr("offensive_rebounds || '+' || defensive_rebounds || ' ' || total_rebounds")
    v, w = n.parse_rebounds(cell), n.parse_rebounds(F.col("plus_minus").cast("string"))
    return t.stats.select(*KEY_LIST, v.alias("v"), w.alias("w")).select(
        *KEY_LIST, "v.offensive", "v.defensive", "v.total", F.col("w.total").alias("lone"))


@query("minutes_decimal", sql("b_stats",
       f"SELECT {KEYS}, points + (part_id % 60) / 60.0::double AS minutes, points + 0.25::double AS plain FROM b_stats"))
def _(t):
    return t.stats.select(
        *KEY_LIST, n.minutes_decimal(F.expr("points || ':' || lpad(cast(part_id % 60 as string), 2, '0')")).alias("minutes"),
        n.minutes_decimal(F.expr("points || ',25'")).alias("plain"))


@query("parse_number", sql("b_stats", f"SELECT {KEYS}, cast(plus_minus as double) AS number, points + 0.5::double AS decimal FROM b_stats"))
def _(t):
    return t.stats.select(*KEY_LIST, n.parse_number(F.expr("'ef. ' || plus_minus || '.00'")).alias("number"),
                          n.parse_number(F.expr("points || ',5%'")).alias("decimal"))


@query("parse_jersey", sql("b_stats", f"SELECT {KEYS}, jersey_number AS jersey, 'Jogador' AS name FROM b_stats"))
def _(t):
    both = x.name_and_jersey(F.expr("'Jogador  #' || jersey_number || ' '"))
    return t.stats.select(*KEY_LIST, x.parse_jersey(F.expr("'# ' || jersey_number")).alias("jersey"), both["name"].alias("name"))


@query("starter_flag", sql("b_stats", f"SELECT {KEYS}, player_name_raw AS name, cast(line_no <= 2 as int) AS is_starter FROM b_stats"))
def _(t):
    marked = F.expr("player_name_raw || case when line_no <= 2 then ' (T)' else '' end")
    return t.stats.select(*KEY_LIST, x.starter_flag(marked).alias("v")).select(*KEY_LIST, "v.name", "v.is_starter")


@query("game_pct", sql("b_stats", f"SELECT {KEYS}, CASE WHEN ft_attempted = 0 THEN 0.0::double ELSE 100.0::double * ft_made / ft_attempted END AS pct FROM b_stats"))
def _(t):
    return t.stats.select(*KEY_LIST, n.game_pct("ft_made", "ft_attempted").alias("pct"))


@query("field_goals", sql("b_stats",
       f"SELECT {KEYS}, two_made + three_made AS made, two_attempted + three_attempted AS attempted,"
       " CASE WHEN two_attempted + three_attempted = 0 THEN 0.0::double ELSE 100.0::double * (two_made + three_made) / (two_attempted + three_attempted) END AS pct FROM b_stats"))
def _(t):
    return t.stats.select(*KEY_LIST, n.field_goals("two_made", "three_made", "two_attempted", "three_attempted").alias("v")) \
        .select(*KEY_LIST, "v.*")


@query("height_weight", "SELECT s_suppkey, 160 + s_suppkey % 60 AS height_cm, 60.5::double + s_nationkey AS weight_kg, 150 + s_suppkey % 80 AS short_cm FROM supplier")
def _(t):
    return t.raw("supplier").select(
        "s_suppkey",
        n.height_weight(F.expr("format_string('%d,%02d / %d,5kg', (160 + s_suppkey % 60) div 100, (160 + s_suppkey % 60) % 100, 60 + s_nationkey)")).alias("v"),
        n.height_weight(F.expr("150 + s_suppkey % 80 || ' cm'")).alias("w"),
    ).select("s_suppkey", "v.*", F.col("w.height_cm").alias("short_cm"))


@query("to_float", "SELECT doc_id, 0.0::double AS as_float, 0::bigint AS as_int, NULL::bigint AS or_null, lang = 'yes' AS truthy,"
       " n_chars + 0.5::double AS size_float, n_chars AS size_int FROM documents")
def _(t):
    size = F.expr("n_chars || ',5'")
    return t.raw(DOCS).select(
        "doc_id", n.to_float("lang").alias("as_float"), n.to_int("lang").alias("as_int"), n.to_int_or_null("lang").alias("or_null"),
        n.to_bool("lang").alias("truthy"), n.to_float(size).alias("size_float"), n.to_int(size).alias("size_int"))


add_view("f_player", ("b_stats",), "SELECT player_id, count(DISTINCT game_id) AS games, cast(sum(points) as bigint) AS points,"
         " cast(sum(ft_made) as bigint) AS made, cast(sum(ft_attempted) as bigint) AS attempted FROM b_stats GROUP BY player_id")


def _by_player(t):
    return t.stats.groupBy("player_id").agg(
        F.count_distinct("game_id").alias("games"), F.sum("points").alias("points"), F.sum("ft_made").alias("made"),
        F.sum("ft_attempted").alias("attempted"))


@query("season_pct", sql("f_player", "SELECT player_id, CASE WHEN attempted > 0 THEN made / attempted END AS pct FROM f_player"))
def _(t):
    return _by_player(t).select("player_id", n.season_pct("made", "attempted").alias("pct"))


@query("per_game", sql("f_player", "SELECT player_id, CASE WHEN games > 0 THEN points / games ELSE 0.0::double END AS mean FROM f_player"))
def _(t):
    return _by_player(t).select("player_id", n.per_game("points", "games").alias("mean"))


add_view("f_wins", ("b_games",), "SELECT home_team_id AS team_id, count(*) AS games, cast(sum(cast(home_score > away_score as int)) as bigint) AS wins FROM b_games GROUP BY 1")


def _home_wins(t):
    return t.games.groupBy(F.col("home_team_id").alias("team_id")).agg(
        F.count("*").alias("games"), F.count_if(F.col("home_score") > F.col("away_score")).alias("wins"))


@query("win_pct", sql("f_wins", "SELECT team_id, 100.0::double * wins / games AS pct FROM f_wins"))
def _(t):
    return _home_wins(t).select("team_id", n.win_pct("wins", "games").alias("pct"))


@query("record_text", sql("f_wins", "SELECT team_id, cast(wins as string) || '-' || cast(games - wins as string) AS record FROM f_wins"))
def _(t):
    return _home_wins(t).select("team_id", n.record_text("wins", F.col("games") - F.col("wins")).alias("record"))


@query("display_name", sql("b_players", f"SELECT id, coalesce({s_clean('full_name')}, {s_clean('display_name')}, 'Jogador ' || cast(id as string)) AS name FROM b_players"))
def _(t):
    return t.players.select("id", n.display_name("full_name", "display_name", F.expr("'Jogador ' || id")).alias("name"))


# --- game rules ---------------------------------------------------------------------------------

STAGE = ("CASE phase WHEN 'Final' THEN 'final' WHEN 'Semifinal' THEN 'semifinal' WHEN 'Quartas de final' THEN 'quartas' END")


@query("stage_from_game", sql("b_games", f"SELECT id, {STAGE} AS stage FROM b_games"))
def _(t):
    return t.games.select("id", g.stage_from_game("phase", "round").alias("stage"))


WINNER = "CASE WHEN home_score > away_score THEN home_team_id WHEN away_score > home_score THEN away_team_id END"


@query("winner", sql("b_games", f"SELECT id, {WINNER} AS winner_team_id FROM b_games"))
def _(t):
    return t.games.select("id", g.winner("home_team_id", "away_team_id", "home_score", "away_score").alias("winner_team_id"))


def s_result(own, other):
    return f"CASE WHEN {own} > {other} THEN 'W' WHEN {own} < {other} THEN 'L' WHEN {own} = {other} THEN 'T' END"


@query("game_result", sql("b_games", f"SELECT id, {s_result('home_score', 'away_score')} AS result FROM b_games"))
def _(t):
    return t.games.select("id", g.game_result("home_score", "away_score").alias("result"))


@query("side_and_opponent", sql("b_games",
       f"SELECT id, CASE WHEN home_team_id < 15 THEN 'home' WHEN away_team_id = 0 THEN 'away' END AS home_away,"
       " CASE WHEN home_team_id < 15 THEN away_team_id WHEN away_team_id = 0 THEN home_team_id END AS opponent_team_id,"
       " CASE WHEN home_team_id < 15 THEN home_score WHEN away_team_id = 0 THEN away_score END AS team_score,"
       " CASE WHEN home_team_id < 15 THEN away_score WHEN away_team_id = 0 THEN home_score END AS opponent_score,"
       f" CASE WHEN home_team_id < 15 THEN {s_result('home_score', 'away_score')} WHEN away_team_id = 0 THEN {s_result('away_score', 'home_score')} END AS result FROM b_games"))
def _(t):
    team = F.expr("case when home_team_id < 15 then home_team_id else 0 end")
    view = g.side_and_opponent(team, "home_team_id", "away_team_id", "home_score", "away_score")
    return t.games.select("id", view.alias("v")).select("id", "v.*")


@query("team_ids_for_side", sql("b_games", "SELECT id, side, CASE WHEN side = 'home' THEN home_team_id ELSE away_team_id END AS team_id,"
       " CASE WHEN side = 'home' THEN away_team_id ELSE home_team_id END AS opponent_team_id FROM b_games, (VALUES ('home'), ('away')) s(side)"))
def _(t):
    sided = t.games.withColumn("side", F.explode(F.array(F.lit("home"), F.lit("away"))))
    return sided.select("id", "side", g.team_ids_for_side("side", "home_team_id", "away_team_id").alias("v")).select("id", "side", "v.*")


@query("stage_label", sql("b_games",
       "SELECT id, cast(CASE phase WHEN 'Final' THEN 5 WHEN 'Semifinal' THEN 4 WHEN 'Quartas de final' THEN 3 ELSE 0 END as bigint) AS stage_order,"
       " CASE phase WHEN 'Final' THEN 'vice-campeão' WHEN 'Semifinal' THEN 'semifinal' WHEN 'Quartas de final' THEN 'quartas' ELSE 'não classificou' END AS label FROM b_games"))
def _(t):
    order = F.coalesce(g.stage_order(g.stage_from_game("phase", "round")), F.lit(0))
    return t.games.select("id", order.cast("bigint").alias("stage_order"), g.stage_label(order).alias("label"))


@query("abbr", "SELECT c_custkey, c_mktsegment AS capitals, replace(c_name || ' X1 abc', ' ', '') AS squeezed FROM customer")
def _(t):
    return t.raw("customer").select(
        "c_custkey", x.abbr(F.expr("c_name || '  ' || c_mktsegment || ' XYZ'")).alias("capitals"),
        x.abbr(F.expr("replace(c_name || ' X1 abc', 'X1', 'x1')")).alias("low")).select(
        "c_custkey", "capitals", F.replace("low", F.lit("x1"), F.lit("X1")).alias("squeezed"))


@query("age", "SELECT s_suppkey, date_diff('year', birth, ref) - cast((month(ref), day(ref)) < (month(birth), day(birth)) as bigint) AS age"
       " FROM (SELECT s_suppkey, DATE '1980-01-01' + cast(s_suppkey % 9000 as int) AS birth, DATE '2024-03-01' AS ref FROM supplier)")
def _(t):
    return t.players.select(F.col("id").alias("s_suppkey"), n.age("birth_date", F.lit("2024-03-01")).alias("age"))


@query("format_cell", sql("b_games",
       "SELECT id, strftime(game_date, '%d/%m/%Y') AS shown_date, cast(home_score as string) AS shown_score,"
       " printf('%.1f', home_score + 0.3) AS shown_float, printf('%.1f', 100 * (home_score / 250.0::double)) || '%' AS shown_pct,"
       " coalesce(boxscore_url, '-') AS shown_url, CASE WHEN home_score > away_score THEN 'Sim' ELSE 'Não' END AS shown_won FROM b_games"))
def _(t):
    c = n.format_cell
    return t.games.select(
        "id", c("game_date", "date").alias("shown_date"), c("home_score", "number").alias("shown_score"),
        c(F.col("home_score") + 0.3, "number").alias("shown_float"), c(F.col("home_score") / 250.0, "pct").alias("shown_pct"),
        c("boxscore_url", "text").alias("shown_url"), c(F.col("home_score") > F.col("away_score"), "bool").alias("shown_won"))


def s_metric(c):
    whens = " ".join(
        rf"WHEN regexp_matches({s_fold(c)}, '(^|[^\p{{L}}\p{{N}}_]){word}($|[^\p{{L}}\p{{N}}_])') THEN '{metric}'"
        for word, metric in x.metric_words())
    return f"CASE {whens} END"


@query("metric_from_text", sql("b_questions", f"SELECT question_id, {s_metric('question')} AS metric FROM b_questions"))
def _(t):
    return t.questions.select("question_id", x.metric_from_text("question").alias("metric"))


@query("resolve_metric_column", sql("b_stats", "SELECT season_id, cast(sum(points) as bigint) AS points, max(total_rebounds) AS best_rebounds FROM b_stats GROUP BY season_id"))
def _(t):
    points = catalog.metric_column("points", t.stats.columns, PLAYER_METRICS)
    rebounds = catalog.metric_column("rebounds", t.stats.columns, PLAYER_METRICS)
    return t.stats.groupBy("season_id").agg(F.sum(points).alias("points"), F.max(rebounds).alias("best_rebounds"))


@query("available_metrics", sql("b_stats",
       "SELECT 'points' AS key, 'Pontos' AS label, 'points' AS \"column\", cast(max(points) as double) AS best FROM b_stats"
       " UNION ALL SELECT 'rebounds', 'Rebotes', 'total_rebounds', cast(max(total_rebounds) as double) FROM b_stats"
       " UNION ALL SELECT 'assists', 'Assistências', 'assists', cast(max(assists) as double) FROM b_stats"
       " UNION ALL SELECT 'steals', 'Roubos', 'steals', cast(max(steals) as double) FROM b_stats"
       " UNION ALL SELECT 'blocks', 'Tocos', 'blocks', cast(max(blocks) as double) FROM b_stats"
       " UNION ALL SELECT 'efficiency', 'Eficiência', 'efficiency', cast(max(efficiency) as double) FROM b_stats"))
def _(t):
    metrics = catalog.player_metrics(t.stats)
    best = t.stats.agg(*[F.max(F.col(c).cast("double")).alias(c)
                         for c in ("points", "total_rebounds", "assists", "steals", "blocks", "efficiency")])
    long = best.unpivot([], best.columns, "column", "best")
    return metrics.join(long, "column")
