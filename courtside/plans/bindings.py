"""League tables derived from the driver's tables.

Orders play the games, line items the player lines, suppliers the players, nations
name the teams, parts give raw names.  Column definitions are SQL text that Spark
and ANSI engines read alike; the same text builds the DataFrames here and the common
table expressions of the comparison SQL (``sql``).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import STAT_INPUTS
from ..operators import ask as ask_ops
from ..operators import resolve as resolve_ops
from ..operators import rollups, standings
from ..session import cut_lineage, spread, tasks_for

GAMES = {
    "id": "o_orderkey",
    "season_id": "cast(year(o_orderdate) as bigint)",
    "competition": "o_orderstatus",
    "game_date": "cast(o_orderdate as date)",
    "game_time": "case when o_orderkey % 2 = 0 then '20:00' else '18:30' end",
    "home_team_id": "o_custkey % 30",
    "away_team_id": "(o_custkey % 30 + 1 + o_orderkey % 29) % 30",
    "home_score": "60 + cast(floor(o_totalprice) as bigint) % 61",
    "away_score": "60 + cast(floor(o_totalprice * 100) as bigint) % 61",
    "phase": "case o_orderpriority when '1-URGENT' then 'Final' when '2-HIGH' then 'Semifinal'"
             " when '3-MEDIUM' then 'Quartas de final' else '1º Turno' end",
    "round": "'Rodada ' || cast(o_custkey % 30 as string)",
    "home_team_abbr_raw": "'T' || cast(o_custkey % 30 as string) || substr(o_orderpriority, 1, 1)",
    "away_team_abbr_raw": "'T' || cast((o_custkey % 30 + 1 + o_orderkey % 29) % 30 as string)",
    "boxscore_url": "case when o_orderstatus = 'P' then null"
                    " else 'https://example.org/jogos/' || cast(o_orderkey as string) end",
}

Q = "cast(l_quantity as bigint)"
STATS = {
    "game_id": "l_orderkey",
    "season_id": "season_id",
    "competition": "competition",
    "team_id": "case when l_linenumber % 2 = 0 then home_team_id else away_team_id end",
    "opponent_team_id": "case when l_linenumber % 2 = 0 then away_team_id else home_team_id end",
    "player_id": "l_suppkey",
    "player_name_raw": "'Jogador ' || cast(l_suppkey as string)",
    "jersey_number": "cast(l_linenumber as string)",
    "line_no": "cast(l_linenumber as bigint)",
    "part_id": "l_partkey",
    "is_starter": "case when l_linenumber <= 2 then '1' else '0' end",
    "minutes_decimal": "l_quantity",
    "points": Q,
    "fg_made": f"l_linenumber + {Q} % 5",
    "fg_attempted": f"l_linenumber + {Q} % 5 + l_partkey % 12",
    "three_made": "cast(l_linenumber as bigint)",
    "three_attempted": "l_linenumber + l_partkey % 5",
    "two_made": f"{Q} % 5",
    "two_attempted": f"{Q} % 5 + l_partkey % 7",
    "ft_made": "l_partkey % 6",
    "ft_attempted": "l_partkey % 6 + l_suppkey % 3",
    "offensive_rebounds": "l_partkey % 4",
    "defensive_rebounds": "l_partkey % 9",
    "total_rebounds": "l_partkey % 4 + l_partkey % 9",
    "assists": "(l_partkey + l_linenumber) % 12",
    "steals": "(l_partkey * 3 + l_linenumber) % 5",
    "blocks": "(l_partkey * 7) % 4",
    "turnovers": f"(l_partkey + {Q}) % 6",
    "fouls_committed": "(l_orderkey + l_linenumber) % 6",
    "fouls_received": "l_orderkey % 5",
    "dunks": "l_partkey % 3",
    "plus_minus": "(l_orderkey + l_partkey) % 41 - 20",
    "efficiency": f"{Q} + l_partkey % 9 - l_partkey % 7 + (l_partkey + l_linenumber) % 12",
}

TEAMS = {
    "id": "t.id",
    "canonical_name": "n_name",
    "slug": "coalesce(lower(replace(n_name, '_', '-')), 'equipe-' || cast(t.id as string))",
    "abbreviation": "'T' || cast(t.id as string)",
    "first_seen_season_id": "first_seen_season_id",
    "last_seen_season_id": "last_seen_season_id",
}
SEASONS = {
    "id": "id",
    "name": "cast(id as string) || '-' || substr(cast(id + 1 as string), 3, 2)",
    "slug": "cast(id as string)",
    "start_year": "id",
    "end_year": "id + 1",
    "start_date": "start_date",
    "end_date": "end_date",
}
PLAYERS = {
    "id": "s_suppkey",
    "full_name": "case when s_nationkey = 0 then null else s_name end",
    "display_name": "case when s_nationkey = 0 then null else 'S' || cast(s_suppkey as string) end",
    "slug": "lower(replace(s_name, '#', '-'))",
    "birth_date": "cast('1980-01-01' as date) + cast(s_suppkey % 9000 as int)",
    "position": "case when s_nationkey % 3 = 0 then 'Ala' when s_nationkey % 3 = 1 then 'Pivô' else 'Armador' end",
}
# nicknames under which questions may name a player
NICKNAMES = {
    "id": "s_suppkey",
    "player_id": "s_suppkey",
    "alias": "'Atleta ' || cast(s_suppkey as string)",
}

# --- the resolution pool: parts as players, their brand and size as context -------------
BRAND = "cast(replace(p_brand, 'Brand#', '') as bigint)"
# three neighbouring parts share a surname, so some of them share the whole name
SURNAME = "substr(md5(cast(cast(floor(p_partkey / 3) as bigint) as string)), 1, 8)"
FIRST = "split_part(p_name, ' ', 1)"
POOL_PLAYERS = {
    "id": "p_partkey",
    "full_name": f"{FIRST} || ' ' || {SURNAME}",
    "display_name": f"case when p_size % 4 = 0 then {FIRST} || ' ' || {SURNAME} || ' jr' else null end",
}
POOL_ALIASES = {
    "id": "p_partkey",
    "player_id": "p_partkey",
    "alias": f"{FIRST} || ' ' || {SURNAME}",
    "season_id": "1992 + cast(p_size % 7 as bigint)",
    "team_id": f"nullif({BRAND} % 6, 0)",
    "jersey_number": "case when p_size % 5 = 0 then null else cast(p_size % 8 as string) end",
    "alias_type": "'stats_display_name'",
    "team_name_raw": f"'Time ' || cast({BRAND} % 6 as string)",
    "source": "'pool'",
}
# statistic lines with a raw name only; the name is written in other ways than the pool
OPEN_LINES = {
    "game_id": "l_orderkey",
    "season_id": "1992 + l_suppkey % 7",
    "team_id": "nullif(l_orderkey % 6, 0)",
    "player_name_raw": f"case when l_linenumber = 1 then '   ' when l_linenumber = 2 then 'Zé ' || {SURNAME}"
                       f" when l_linenumber = 3 then upper({FIRST}) || ' (T) ' || {SURNAME}"
                       f" when l_linenumber = 4 then replace({FIRST}, 'e', 'é') || '-' || {SURNAME}"
                       f" when l_linenumber = 5 then {FIRST} || 's ' || {SURNAME} when l_linenumber = 6 then upper({SURNAME})"
                       f" else {FIRST} || ' ' || {SURNAME} end",
    "jersey_number": "case when l_linenumber = 7 then null else cast(cast(l_quantity as bigint) % 8 as string) end",
    "points": Q,
}

# --- questions about the league's players ------------------------------------------------
QUESTIONS = (
    "s_name || ' últimos ' || cast(s_suppkey % 9 + 1 as string) || ' jogos'",
    "s_name || ' VS Atleta ' || cast((s_suppkey + 1) % 10 as string) || ' ultimos 4 jogos'",
    "'Top 3 jogos com mais pontos do ' || s_name",
    "'top ' || cast(s_suppkey % 4 + 2 as string) || ' partidas do Atleta ' || cast(s_suppkey as string) || ' com mais rebotes'",
    "'top ' || cast(s_suppkey % 20 + 1 as string) || ' assistências'",
    "'Top 10 times com mais vitórias na história'",
    "'estatísticas de atleta ' || cast(s_suppkey as string)",
    "'top 5 equipes com mais tocos'",
    "'jogos do ' || substr(lower(s_name), 1, 17)",
    "'top 3 xyz'",
)


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS {name}" for name, expr in columns.items()])


def _columns(columns: dict[str, str]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in columns.items())


class League:
    """The bound tables of one data folder, built lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def games(self) -> DataFrame:
        return _select(self.raw("orders"), GAMES)

    @cached_property
    def stats(self) -> DataFrame:
        sides = self.games.select("id", "season_id", "competition", "home_team_id", "away_team_id")
        lines = spread(self.raw("lineitem"), "l_orderkey").join(sides, F.col("l_orderkey") == F.col("id"))
        return _select(lines, STATS)

    @cached_property
    def line_tasks(self) -> int:
        return tasks_for(self.raw("lineitem"))

    @cached_property
    def team_stats(self) -> DataFrame:
        return rollups.team_game_stats(self.stats)

    @cached_property
    def teams(self) -> DataFrame:
        seen = self.games.groupBy(F.col("home_team_id").alias("id")).agg(
            F.min("season_id").alias("first_seen_season_id"), F.max("season_id").alias("last_seen_season_id")
        ).alias("t")
        return _select(seen.join(self.raw("nation"), F.col("t.id") == F.col("n_nationkey"), "left"), TEAMS)

    @cached_property
    def seasons(self) -> DataFrame:
        years = self.games.groupBy(F.col("season_id").alias("id")).agg(
            F.min("game_date").alias("start_date"), F.max("game_date").alias("end_date")
        )
        latest = self.games.select(F.max("season_id")).scalar()
        return _select(years, SEASONS).withColumn("is_current", (F.col("id") == latest).cast("bigint"))

    @cached_property
    def players(self) -> DataFrame:
        return _select(self.raw("supplier"), PLAYERS)

    @cached_property
    def nicknames(self) -> DataFrame:
        return _select(self.raw("supplier"), NICKNAMES)

    @cached_property
    def standings(self) -> DataFrame:
        return standings.standings(self.games, self.teams, self.seasons)

    @cached_property
    def player_team_seasons(self) -> DataFrame:
        return rollups.player_team_seasons(self.stats, self.players, self.teams, self.seasons, self.line_tasks)

    @cached_property
    def player_seasons(self) -> DataFrame:
        return rollups.player_seasons(self.player_team_seasons)

    @cached_property
    def career(self) -> DataFrame:
        return rollups.player_career_totals(self.player_team_seasons, self.seasons)

    @cached_property
    def team_seasons(self) -> DataFrame:
        return rollups.team_seasons(self.team_stats, self.standings, self.teams, self.seasons)

    @cached_property
    def pool_players(self) -> DataFrame:
        return _select(self.raw("part"), POOL_PLAYERS)

    @cached_property
    def pool_aliases(self) -> DataFrame:
        return _select(self.raw("part"), POOL_ALIASES)

    @cached_property
    def records(self) -> DataFrame:
        return resolve_ops.name_records(self.pool_players, self.pool_aliases)

    @cached_property
    def open_lines(self) -> DataFrame:
        parts = self.raw("part").select("p_partkey", "p_name")
        lines = self.raw("lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
        return _select(lines, OPEN_LINES).withColumn("player_id", F.lit(None).cast("bigint"))

    @cached_property
    def groups(self) -> DataFrame:
        """Open lines by request, written out once: matching reads them several times."""
        return cut_lineage(resolve_ops.unresolved_groups(self.open_lines, ["game_id"]))

    @cached_property
    def stored_records(self) -> DataFrame:
        return cut_lineage(self.records)

    @cached_property
    def questions(self) -> DataFrame:
        texts = ", ".join(QUESTIONS)
        return self.raw("supplier").selectExpr("s_suppkey", f"posexplode(array({texts})) AS (k, question)").selectExpr(
            "s_suppkey * 10 + k AS question_id", "question"
        )

    @cached_property
    def parsed(self) -> DataFrame:
        """Parsed questions, written out once: every answer reads them several times."""
        return cut_lineage(ask_ops.question_intent(self.questions))

    @cached_property
    def named(self) -> DataFrame:
        return cut_lineage(ask_ops.named_players(self.parsed, self.players, self.nicknames))


# --- the same tables as SQL -----------------------------------------------------------------

_SUMS = ", ".join(f"cast(sum({s}) as bigint) AS {s}" for s in STAT_INPUTS)

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "b_games": ((), f"SELECT {_columns(GAMES)} FROM orders"),
    "b_stats": (("b_games",), f"SELECT {_columns(STATS)} FROM lineitem JOIN b_games ON l_orderkey = id"),
    "b_team_stats": (("b_stats",),
        f"SELECT game_id, season_id, competition, team_id, opponent_team_id, {_SUMS} FROM b_stats"
        " GROUP BY game_id, season_id, competition, team_id, opponent_team_id"),
    "b_teams": (("b_games",),
        f"SELECT {_columns(TEAMS)} FROM (SELECT home_team_id AS id, min(season_id) AS first_seen_season_id,"
        " max(season_id) AS last_seen_season_id FROM b_games GROUP BY home_team_id) t"
        " LEFT JOIN nation ON t.id = n_nationkey"),
    "b_seasons": (("b_games",),
        f"SELECT {_columns(SEASONS)}, cast(id = (SELECT max(season_id) FROM b_games) as bigint) AS is_current"
        " FROM (SELECT season_id AS id, min(game_date) AS start_date, max(game_date) AS end_date"
        " FROM b_games GROUP BY season_id) y"),
    "b_players": ((), f"SELECT {_columns(PLAYERS)} FROM supplier"),
    "b_nicknames": ((), f"SELECT {_columns(NICKNAMES)} FROM supplier"),
    "b_pool_players": ((), f"SELECT {_columns(POOL_PLAYERS)} FROM part"),
    "b_pool_aliases": ((), f"SELECT {_columns(POOL_ALIASES)} FROM part"),
    "b_records": (("b_pool_players", "b_pool_aliases"),
        "SELECT player_id, alias AS name, season_id, team_id, jersey_number, source FROM b_pool_aliases"
        " UNION ALL SELECT id, full_name, NULL, NULL, NULL, 'players.full_name' FROM b_pool_players"
        " UNION ALL SELECT id, display_name, NULL, NULL, NULL, 'players.display_name' FROM b_pool_players"
        " WHERE display_name IS NOT NULL"),
    "b_open_lines": ((),
        f"SELECT {_columns(OPEN_LINES)} FROM lineitem JOIN part ON l_partkey = p_partkey"),
    "b_questions": ((),
        " UNION ALL ".join(f"SELECT s_suppkey * 10 + {k} AS question_id, {text} AS question FROM supplier"
                           for k, text in enumerate(QUESTIONS))),
}


COMPUTE_ONCE = ("b_parsed", "b_found", "b_named", "b_groups", "b_wordy", "b_pairs", "b_review_pairs", "b_scored", "b_alike", "b_met", "b_review")


def add_view(name: str, needs: tuple[str, ...], text: str) -> None:
    VIEWS[name] = (needs, text)


def sql(needs: tuple[str, ...] | str, body: str) -> str:
    """A query with the common table expressions it needs, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dependency in VIEWS[name][0]:
            visit(dependency)
        if name not in ordered:
            ordered.append(name)

    for name in (needs,) if isinstance(needs, str) else needs:
        visit(name)
    ctes = ", ".join(f"{n} AS {'MATERIALIZED ' if n in COMPUTE_ONCE else ''}({VIEWS[n][1]})" for n in ordered)
    return f"WITH {ctes} {body}" if ctes else body
