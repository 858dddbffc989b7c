"""Filtered lists, rankings, search and games of players: the read side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    GAMES_COLUMNS, HISTORY_EXCLUDED, HISTORY_EXCLUDED_PARTS, LINE_COLUMNS, PAGE_DEFAULT, PAGE_MAX,
    RECENT_GAMES_DEFAULT, RECENT_GAMES_MAX, SEARCH_COLUMNS, SEARCH_ORDER,
)
from ..functions.text import blank_to_null, strip_accents
from ..sources.catalog import first_present
from .positions import top_per_group
from .standings import team_names

# --- paging -----------------------------------------------------------------------


def clamp_page(limit: int, offset: int = 0) -> tuple[int, int]:
    return max(1, min(limit, PAGE_MAX)), max(0, offset)


def order_existing(df: DataFrame, columns: tuple, unique: tuple = ("id",)) -> list[Column]:
    """Sort columns the table has, completed by a unique key.

    A leading ``-`` sorts descending.
    """
    wanted = [*columns, *[c for c in unique if c not in {x.lstrip("-") for x in columns}]]
    return [
        F.desc(c[1:]) if c.startswith("-") else F.asc(c)
        for c in wanted if c.lstrip("-") in df.columns
    ]


def paginate(df: DataFrame, order: list, limit: int = PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """One page in a stated order; the planner keeps limit+offset rows per task."""
    limit, offset = clamp_page(limit, offset)
    return df.orderBy(*order).offset(offset).limit(limit)


def total_rows(df: DataFrame) -> DataFrame:
    """Row count of a filtered list, to go with a page of it."""
    return df.agg(F.count("*").alias("total"))


# --- filters ------------------------------------------------------------------------


def equality_filters(df: DataFrame, **values) -> DataFrame:
    """AND of ``column = value``; a None value or unknown column is no condition."""
    conditions = [F.col(c) == v for c, v in values.items() if v is not None and c in df.columns]
    return df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df


def text_search(df: DataFrame, query: str, columns: tuple, ignore_accents: bool = False) -> DataFrame:
    """Rows in which one of the columns contains the text, whatever its case.

    A blank query, or none of the columns present, finds nothing.
    """
    query = query.strip()
    present = [c for c in columns if c in df.columns]
    if not query or not present:
        return df.limit(0)
    form = (lambda c: strip_accents(F.lower(c))) if ignore_accents else F.lower
    needle = form(F.lit(query))
    hits = [F.contains(form(F.col(c).cast("string")), needle) for c in present]
    return df.filter(reduce(lambda a, b: a | b, hits))


def games_column(df: DataFrame) -> str | None:
    return first_present(GAMES_COLUMNS, df.columns)


def min_games(df: DataFrame, n: int) -> DataFrame:
    column = games_column(df)
    return df.filter(F.col(column).try_cast("double") >= n) if n > 0 and column else df


def metric_present(df: DataFrame, column: str) -> DataFrame:
    return df.filter(blank_to_null(column).isNotNull())


def team_games(games: DataFrame, team_id) -> DataFrame:
    """Games of a team at home or away."""
    sides = [c for c in ("home_team_id", "away_team_id", "team_id") if c in games.columns]
    return games.filter(reduce(lambda a, b: a | b, [F.col(c) == team_id for c in sides]))


def active_in_season(teams: DataFrame, season_id, first: int = 1, last: int | None = None) -> DataFrame:
    """Teams whose first and last season enclose the given one.

    A team without a first season counts from ``first``; one without a last season up to
    ``last``, or without end.
    """
    return teams.filter(
        F.lit(season_id).between(
            F.coalesce("first_seen_season_id", F.lit(first)), F.coalesce("last_seen_season_id", F.lit(season_id if last is None else last))
        )
    )


def active_teams(teams: DataFrame, current_season) -> DataFrame:
    return teams.filter(F.coalesce("last_seen_season_id", F.lit(0)) >= current_season)


def players_by_current_team(players: DataFrame, team_id) -> DataFrame:
    return players.filter(F.col("current_team_id") == team_id)


def latest_season_games(player_games: DataFrame, players: DataFrame) -> DataFrame:
    """Each player's games in the last season that player was seen in."""
    last = players.select(F.col("id").alias("player_id"), F.col("last_seen_season_id").alias("season_id"))
    return player_games.join(last, ["player_id", "season_id"], "left_semi")


def has_boxscore_url(games: DataFrame, limit: int | None = None) -> DataFrame:
    found = games.filter(blank_to_null("boxscore_url").isNotNull())
    return found.orderBy("id").limit(limit) if limit else found


# --- lists ---------------------------------------------------------------------------


def current_season(seasons: DataFrame) -> DataFrame:
    """One row: the season flagged as current, else the latest."""
    return seasons.agg(
        F.coalesce(F.max(F.when(F.col("is_current") == 1, F.col("id"))), F.max("id")).alias("season_id")
    )


def list_rows(df: DataFrame, filters: dict | None = None, search: str | None = None, search_columns: tuple = (),
              order: tuple = ("id",), limit: int = PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """A filtered, searched and ordered page of any table."""
    rows = equality_filters(df, **(filters or {}))
    if search:
        rows = text_search(rows, search, search_columns)
    return paginate(rows, order_existing(df, order), limit, offset)


def list_seasons(seasons: DataFrame, limit: int = PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    return list_rows(seasons, order=("start_year", "id"), limit=limit, offset=offset)


def list_teams(teams: DataFrame, q: str | None = None, limit: int = PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    return list_rows(teams, search=q, search_columns=("canonical_name", "name", "slug"),
                     order=("canonical_name", "name", "id"), limit=limit, offset=offset)


def list_standings(standings: DataFrame, season_id=None, team_id=None, limit: int = PAGE_DEFAULT,
                   offset: int = 0) -> DataFrame:
    rows = equality_filters(standings, season_id=season_id, team_id=team_id)
    return paginate(rows, ["season_id", "competition", "rank", "team_id"], limit, offset)


def list_games(games: DataFrame, season_id=None, team_id=None, limit: int = PAGE_DEFAULT,
               offset: int = 0) -> DataFrame:
    """Games newest first."""
    rows = equality_filters(games, season_id=season_id)
    if team_id is not None:
        rows = team_games(rows, team_id)
    return paginate(rows, [F.desc("game_date"), F.desc("id")], limit, offset)


def row_by_id(df: DataFrame, row_id) -> DataFrame:
    return df.filter(F.col("id") == row_id).limit(1)


def rows_by_foreign_id(df: DataFrame, column: str, value, order: tuple = ("id",),
                       unique: tuple = ("id",), limit: int = PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    return paginate(df.filter(F.col(column) == value), order_existing(df, order, unique), limit, offset)


def game_stats(stats: DataFrame, game_id, unique: tuple = ("id",), limit: int = PAGE_DEFAULT,
               offset: int = 0) -> DataFrame:
    """Lines of one game by team and player."""
    return rows_by_foreign_id(stats, "game_id", game_id, ("team_id", "player_id"), unique, limit, offset)


def standings_by_wins(standings: DataFrame) -> DataFrame:
    return standings.orderBy(F.desc("wins"), "season_id", "competition", "rank")


def sample_head(df: DataFrame, order: list, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


# --- joins with context -----------------------------------------------------------------


def _game_columns(games: DataFrame, names: tuple) -> list[Column]:
    return [F.col(c) for c in names if c in games.columns]


def player_games(stats: DataFrame, games: DataFrame, player_id=None) -> DataFrame:
    """Lines of one player (or of all) with date, sides and scores of the game."""
    rows = stats if player_id is None else stats.filter(F.col("player_id") == player_id)
    wanted = ("game_date", "game_time", "home_team_id", "away_team_id", "home_score", "away_score",
              "home_team_name_raw", "away_team_name_raw", "winner_team_id")
    have = tuple(c for c in wanted if c not in stats.columns)
    context = games.select(F.col("id").alias("game_id"), *_game_columns(games, have))
    return rows.join(context, "game_id", "left")


NEWEST_FIRST = ("-game_date", "-game_time", "-game_id")


def list_player_games(stats: DataFrame, games: DataFrame, player_id, unique: tuple = ("-id",),
                      limit: int = PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    rows = player_games(stats, games, player_id)
    return paginate(rows, order_existing(rows, (*NEWEST_FIRST, *unique), ()), limit, offset)


def ranking_context(rows: DataFrame, players: DataFrame, teams: DataFrame) -> DataFrame:
    """Names and slugs for whichever of player and team a rollup has."""
    if "player_id" in rows.columns:
        rows = rows.drop("player_name").join(
            players.select(
                F.col("id").alias("player_id"),
                F.coalesce(blank_to_null("display_name"), blank_to_null("full_name")).alias("player_name"),
                F.col("slug").alias("player_slug"),
            ),
            "player_id", "left",
        )
    key = first_present(("team_id", "primary_team_id"), rows.columns)
    if key:
        names = teams.join(team_names(teams).withColumnRenamed("team_id", "id"), "id").select(
            F.col("id").alias(key), "team_name", F.col("slug").alias("team_slug")
        )
        rows = rows.drop("team_name").join(names, key, "left")
        rows = rows.withColumn("team_id", F.col(key))
    return rows


def game_context(lines: DataFrame, players: DataFrame, teams: DataFrame, games: DataFrame) -> DataFrame:
    """Player, team, opponent and game of each line, under prefixed names."""
    slugs = teams.join(team_names(teams).withColumnRenamed("team_id", "id"), "id").select("id", "team_name", "slug")
    wanted = ("game_date", "season_id", "home_team_id", "away_team_id", "home_score", "away_score",
              "phase", "round", "arena", "boxscore_url")
    return (
        lines.join(
            players.select(F.col("id").alias("player_id"),
                           F.coalesce(blank_to_null("full_name"), blank_to_null("display_name")).alias("entity_player_name"),
                           F.col("slug").alias("entity_player_slug")), "player_id", "left")
        .join(slugs.toDF("team_id", "entity_team_name", "entity_team_slug"), "team_id", "left")
        .join(slugs.toDF("opponent_team_id", "entity_opponent_team_name", "entity_opponent_team_slug"),
              "opponent_team_id", "left")
        .join(games.select(F.col("id").alias("game_id"),
                           *[F.col(c).alias(f"game_{c}") for c in wanted if c in games.columns]), "game_id", "left")
    )


def players_current_team(players: DataFrame, player_seasons: DataFrame, teams: DataFrame, season_id,
                         how: str = "inner") -> DataFrame:
    """Players with the team they mostly play for in the current season.

    ``how='left'`` keeps players without a team this season (the detail view).
    """
    now = player_seasons.filter(F.col("season_id") == season_id).select(
        F.col("player_id").alias("id"), F.col("primary_team_id").alias("current_team_id")
    )
    named = team_names(teams).toDF("current_team_id", "current_team_name")
    if "logo_url" in teams.columns:
        logos = teams.select(F.col("id").alias("current_team_id"), F.col("logo_url").alias("current_team_logo_url"))
        named = named.join(logos, "current_team_id")
    return players.join(now, "id", how).join(named, "current_team_id", how)


def list_players(players: DataFrame, player_seasons: DataFrame, teams: DataFrame, season_id,
                 q: str | None = None, limit: int = PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    rows = players_current_team(players, player_seasons, teams, season_id)
    if q:
        rows = text_search(rows, q, ("display_name", "full_name", "slug"))
    return paginate(rows, ["display_name", "full_name", "id"], limit, offset)


# --- rankings ---------------------------------------------------------------------------


def rank_by_metric(df: DataFrame, column: str, unique: list, season_id=None, team_id=None, games: int = 0,
                   limit: int = PAGE_DEFAULT, offset: int = 0, higher_is_better: bool = True) -> DataFrame:
    """A page of a table ordered by one of its columns; ``unique`` breaks ties."""
    team_column = first_present(("team_id", "primary_team_id"), df.columns)
    rows = equality_filters(df, season_id=season_id, **({team_column: team_id} if team_column else {}))
    rows = metric_present(min_games(rows, games), column)
    rows = rows.withColumn("ranking_value", F.col(column).try_cast("double"))
    value = F.col("ranking_value")
    return paginate(rows, [value.desc() if higher_is_better else value.asc(), *unique], limit, offset)


def leaderboard(df: DataFrame, column: str, season_id, unique: list) -> DataFrame:
    """Leader and the next two."""
    return rank_by_metric(df, column, unique, season_id=season_id, limit=3)


def history_columns(df: DataFrame) -> list[str]:
    """Numeric columns that a team's history sums up."""
    return sorted(
        name for name, kind in df.dtypes
        if kind in ("int", "bigint", "double", "float")
        and name not in HISTORY_EXCLUDED and not any(part in name for part in HISTORY_EXCLUDED_PARTS)
    )


def team_history_ranking(by_season: DataFrame, teams: DataFrame, column: str, top: int) -> DataFrame:
    """Teams by the sum of a metric over all their seasons, with all other sums."""
    sums = [F.sum(F.col(c).cast("double")).alias(f"{c}_total") for c in history_columns(by_season)]
    totals = by_season.groupBy("team_id").agg(
        F.count("*").alias("seasons_count"), F.sum(F.col(column).cast("double")).alias("ranking_value"),
        F.array_join(F.array_sort(F.collect_list(F.col("season_id").cast("string"))), "|").alias("season_ids"), *sums,
    )
    return totals.join(team_names(teams), "team_id", "left").orderBy(
        F.desc_nulls_last("ranking_value"), "team_id"
    ).limit(top)


def latest_game_mvp(games: DataFrame, stats: DataFrame, unique: list) -> DataFrame:
    """Best line of the newest game: efficiency, then points."""
    newest = games.orderBy(F.desc("game_date"), F.desc("id")).limit(1).select(
        F.col("id").alias("game_id"), "game_date"
    )
    return stats.join(newest, "game_id").orderBy(F.desc("efficiency"), F.desc("points"), *unique).limit(1)


# --- games of players ---------------------------------------------------------------------


def clamp_games(n: int) -> int:
    return max(1, min(n, RECENT_GAMES_MAX))


def recent_player_games(stats: DataFrame, games: DataFrame, player_id, unique: tuple = ("id",),
                        n: int = RECENT_GAMES_DEFAULT) -> DataFrame:
    return list_player_games(stats, games, player_id, unique, limit=clamp_games(n))


def top_player_games(stats: DataFrame, games: DataFrame, player_id, metric: str, unique: tuple = ("id",),
                     n: int = RECENT_GAMES_DEFAULT) -> DataFrame:
    """One player's games with the highest value of a metric."""
    column = first_present(LINE_COLUMNS[metric], stats.columns)
    if column is None:
        raise KeyError(f"no column for metric: {metric}")
    rows = metric_present(player_games(stats, games, player_id), column).withColumn(
        "ranking_value", F.col(column).try_cast("double")
    )
    return paginate(rows, order_existing(rows, ("-ranking_value", *NEWEST_FIRST, *unique), ()), clamp_games(n))


def _shared_games(lines: DataFrame, first, second) -> DataFrame:
    """Games in which both players appear, not in the same team.

    Repeated lines are reduced to one per game and team before the self-join.
    """
    def of(player, alias: str) -> DataFrame:
        team = lines.filter(F.col("player_id") == player).select("game_id", F.col("team_id").alias(alias))
        return team.distinct()

    apart = F.col("t1").isNull() | F.col("t2").isNull() | (F.col("t1") != F.col("t2"))
    return of(first, "t1").join(of(second, "t2"), "game_id").filter(apart).select("game_id").distinct()


def head_to_head(stats: DataFrame, games: DataFrame, first, second, n: int = RECENT_GAMES_DEFAULT) -> DataFrame:
    """Both players' lines in their newest games against each other."""
    lines = stats.filter(F.col("player_id").isin(first, second))
    dated = _shared_games(lines, first, second).join(
        games.select(F.col("id").alias("game_id"), F.col("game_date").alias("h2h_date")), "game_id", "left"
    )
    newest = dated.orderBy(F.desc("h2h_date"), F.desc("game_id")).limit(clamp_games(n))
    return lines.join(newest, "game_id")


def games_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("game_id").alias("games_count"))


def newest_lines_per_player(stats: DataFrame, games: DataFrame, n: int, unique: tuple = ("id",)) -> DataFrame:
    """The newest ``n`` lines of every player, numbered."""
    rows = player_games(stats.filter(F.col("player_id").isNotNull()), games)
    order = order_existing(rows, (*NEWEST_FIRST, *unique), ())
    return top_per_group(rows, ["player_id"], order, clamp_games(n), "game_position")


# --- search ---------------------------------------------------------------------------------


def search_table(df: DataFrame, table: str, query: str, limit: int = 10) -> DataFrame:
    """Hits of one registered table, in its usual order."""
    hits = text_search(df, query, SEARCH_COLUMNS[table])
    return paginate(hits, order_existing(df, SEARCH_ORDER[table]), limit)


def global_search(tables: dict[str, DataFrame], query: str, limit: int = 10) -> DataFrame:
    """Hits of players, teams, games and seasons, each group capped."""
    shown = {
        "players": ("full_name", "name", "slug"), "teams": ("canonical_name", "name", "slug"),
        "games": ("round", "phase"), "seasons": ("name", "slug"),
    }
    parts = []
    for group, df in tables.items():
        label = [blank_to_null(c) for c in shown[group] if c in df.columns]
        parts.append(
            search_table(df, group, query, limit).select(
                F.lit(group).alias("group"), F.col("id").cast("bigint").alias("id"),
                F.coalesce(*label).alias("label"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def alias_lookup(aliases: DataFrame, players: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Players found through their aliases, with the alias that matched."""
    columns = [c for c in ("alias", "name", "raw_name", "player_name", "full_name", "nickname", "slug")
               if c in aliases.columns]
    hits = text_search(aliases, query, tuple(columns)).select(
        "player_id", F.coalesce(*[F.col(c) for c in columns]).alias("matched_value")
    )
    names = players.select(F.col("id").alias("player_id"), "full_name")
    found = hits.join(names, "player_id", "left").withColumn("matched_via", F.lit("player_aliases"))
    return paginate(found, ["full_name", "player_id", "matched_value"], limit)
