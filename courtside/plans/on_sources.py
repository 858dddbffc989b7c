"""Readers, writers and the catalog, over copies of the given tables."""

from pyspark.sql import functions as F

from ..operators import standings
from ..session import scratch_path
from ..sources import catalog, pages, tables
from . import on_rollups  # noqa: F401  (defines shared views)
from .bindings import sql
from .registry import query

TEXT_GAMES = {  # headers as a spreadsheet would have them
    "Game ID": "id", "Season ID": "season_id", " Phase ": "phase", "Home Team ID": "home_team_id", "Home-Score": "home_score",
    "Away Score": "away_score", "FG%": "home_score + 0.5", "Minutes Text": "game_time", "boxscore url": "boxscore_url",
}


def _csv_of_games(t):
    """Games as a CSV file with untidy headers; returns its path."""
    path = scratch_path(t.spark, "games-csv")
    text = t.games.selectExpr(*[f"cast({expr} AS string) AS `{name}`" for name, expr in TEXT_GAMES.items()])
    tables.write_table(text, path, fmt="csv")
    return path


@query("read_table_csv", sql("b_games", "SELECT cast(id AS string) AS \"Game ID\", cast(season_id AS string) AS \"Season ID\", phase AS \" Phase \", cast(home_team_id AS string) AS \"Home Team ID\","
       " cast(home_score AS string) AS \"Home-Score\", cast(away_score AS string) AS \"Away Score\", cast(home_score AS string) || '.5' AS \"FG%\", game_time AS \"Minutes Text\", boxscore_url AS \"boxscore url\" FROM b_games"))
def _(t):
    return tables.read_table_csv(t.spark, _csv_of_games(t))


@query("normalize_columns", sql("b_games", "SELECT cast(id AS string) AS game_id, cast(season_id AS string) AS season_id, phase, cast(home_team_id AS string) AS home_team_id,"
       " cast(home_score AS string) AS home_score, cast(away_score AS string) AS away_score, cast(home_score AS string) || '.5' AS fg, game_time AS minutes_text, boxscore_url FROM b_games"))
def _(t):
    return tables.normalize_columns(tables.read_table_csv(t.spark, _csv_of_games(t)))


@query("infer_types", sql("b_games", "SELECT c AS \"column\", k AS inferred, CASE c WHEN 'boxscore_url' THEN count(boxscore_url) WHEN 'minutes_text' THEN 0 ELSE count(*) END AS readable FROM b_games,"
       " (VALUES ('game_id', 'bigint'), ('season_id', 'bigint'), ('phase', 'string'), ('home_team_id', 'bigint'), ('home_score', 'string'), ('away_score', 'string'),"
       " ('fg', 'string'), ('minutes_text', 'double'), ('boxscore_url', 'string')) x(c, k) GROUP BY c, k"))
def _(t):
    text = tables.normalize_columns(tables.read_table_csv(t.spark, _csv_of_games(t)))
    schema = tables.infer_types(text.columns)
    counts = tables.coerce_values(text, schema).agg(*[F.count(c).alias(c) for c in text.columns])
    kinds = t.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in schema.fields], "column string, inferred string")
    return kinds.join(counts.unpivot([], counts.columns, "column", "readable"), "column").select("column", "inferred", "readable")


@query("coerce_values", sql("b_stats", "SELECT game_id, cast(points AS string) AS points, points + 0.5::double AS points_avg, player_id, cast(NULL AS double) AS eff FROM b_stats"))
def _(t):
    text = t.stats.selectExpr("' ' || game_id || '.9' AS game_id", "cast(points AS string) || ' ' AS points", "points || ',5' AS points_avg",
                              "cast(player_id AS string) AS player_id", "'abc' AS eff")
    return tables.coerce_values(text)


@query("load_all", "SELECT 'games' AS table_name, 'imported' AS status, count(*) AS rows_imported, 9::int AS columns FROM orders UNION ALL SELECT 'players', 'imported', count(*), 6::int FROM supplier"
       " UNION ALL SELECT n, 'missing_csv', 0, 0::int FROM (VALUES ('seasons'), ('teams'), ('team_aliases'), ('player_aliases'), ('player_game_stats'), ('team_game_stats'), ('standings'), ('team_seasons'),"
       " ('player_team_seasons'), ('player_seasons'), ('player_career_totals'), ('player_records'), ('awards'), ('team_titles')) x(n)")
def _(t):
    folder, out = scratch_path(t.spark, "csv"), scratch_path(t.spark, "loaded")
    tables.write_table(t.games.selectExpr(*[f"cast({expr} AS string) AS `{name}`" for name, expr in TEXT_GAMES.items()]), f"{folder}/games.csv", fmt="csv")
    tables.write_table(t.players.selectExpr(*[f"cast({c} AS string) AS {c}" for c in t.players.columns]), f"{folder}/players.csv", fmt="csv")
    return tables.load_all(t.spark, folder, out).drop("error")


@query("catalog", sql("b_games", "SELECT season_id, count(*) AS games, count(DISTINCT home_team_id) AS teams FROM b_games GROUP BY season_id"))
def _(t):
    return catalog.sql_over({"games": t.games}, "SELECT season_id, count(*) AS games, count(DISTINCT home_team_id) AS teams FROM {games} GROUP BY season_id")


@query("write_table", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def _(t):
    path = scratch_path(t.spark, "orders")
    tables.write_table(t.raw("orders"), path, ["o_orderkey", "o_totalprice", "o_orderstatus"], partition_by=("o_orderstatus",))
    return t.spark.read.parquet(path)


@query("ensure_table", sql("b_champion", "SELECT cast(season_id AS string) AS season_id, competition, cast(team_id AS string) AS team_id, cast(final_wins AS string) AS final_wins FROM b_champion"))
def _(t):
    folder = scratch_path(t.spark, "manual")
    tables.ensure_manual_tables(t.spark, folder)
    titles = standings.season_champion(t.games).selectExpr(
        "cast(season_id AS string) AS season_id", "competition", "cast(team_id AS string) AS team_id", "cast(final_wins AS string) AS final_wins")
    titles.write.mode("append").parquet(f"{folder}/team_titles")
    again = tables.ensure_manual_tables(t.spark, folder)["team_titles"]
    return again.select("season_id", "competition", "team_id", "final_wins")


@query("page_source", "SELECT page_id, url, html FROM pages")
def _(t):
    return pages.page_source(t.spark, f"{t.folder}/pages.parquet")


@query("page_manifest", "SELECT page_id, 'page' AS source_type, url AS source_url, sha256(html) AS content_sha256, length(html) AS html_size, 1::int AS from_cache FROM pages")
def _(t):
    return pages.page_manifest(t.raw("pages"), "page")


@query("changed_pages", "SELECT page_id, url FROM pages WHERE NOT contains(url, '/en/')")
def _(t):
    seen = pages.page_manifest(t.raw("pages").filter(F.contains("url", F.lit("/en/"))), "page")
    return pages.changed_pages(t.raw("pages"), seen).select("page_id", "url")
