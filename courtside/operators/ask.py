"""Templated questions in batch: a table of questions in, intents and answers out.

``parsed`` tables have question_id, question, intent, player_1, player_2,
last_n_games, ranking_target, metric, top_n.  Parsing is a wide set of expressions, and
the answers read its result several times: write it out (or checkpoint it) in between.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    CAREER_COLUMNS, HISTORY_WORDS, LINE_COLUMNS, PREFIXES, RANKING_MAX, RECENT, RECENT_GAMES_DEFAULT, RECENT_GAMES_MAX,
    SEPARATORS, TEAM_WORDS, TOP, TOP_GAMES,
)
from ..functions.text import clean_text, fold, metric_from_text
from ..session import cut_lineage
from ..sources.catalog import first_present
from .positions import top_per_group
from .query import NEWEST_FIRST, newest_lines_per_player, order_existing, player_games
from .standings import team_names

# --- intent ------------------------------------------------------------------------------

EDGE = "[^a-z0-9_]"
PUNCTUATION = r"^[ ,.;:\-]+|[ ,.;:\-]+$"


def _clamped(text: Column, high: int) -> Column:
    """A number from a question, between 1 and ``high`` however long it is."""
    number = text.try_cast("bigint")
    return F.when(text.rlike(r"^\d+$"), F.least(F.greatest(F.coalesce(number, F.lit(high)), F.lit(1)), F.lit(high)))


def _any_in(text: Column, words: tuple) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def question_intent(questions: DataFrame, most_games: int = RECENT_GAMES_MAX, most_places: int = RANKING_MAX) -> DataFrame:
    """Intent and parameters of each question, from its accent-free text.

    Numbers of games and of places are moved into 1 .. ``most_games`` and 1 .. ``most_places``.
    """
    text = F.coalesce(fold("question"), F.lit(""))
    df = questions.withColumn("t", text)
    t = F.col("t")

    tries = []
    for pattern, player_at, metric_at in TOP_GAMES:
        tries.append(F.struct(
            F.regexp_extract(t, pattern, 1).alias("n"), F.btrim(F.regexp_extract(t, pattern, player_at)).alias("player"),
            metric_from_text(F.regexp_extract(t, pattern, metric_at)).alias("metric"), t.rlike(pattern).alias("hit"),
        ))
    df = df.withColumn("tg", F.when(tries[0]["hit"], tries[0]).otherwise(tries[1]))
    is_top_games = F.col("tg.hit") & F.col("tg.metric").isNotNull() & (F.col("tg.player") != "")

    df = df.withColumn("top_text", F.regexp_extract(t, TOP, 2)).withColumn("top_metric", metric_from_text("top_text"))
    is_top = t.rlike(TOP)
    target = F.when(_any_in(F.col("top_text"), TEAM_WORDS), "teams").otherwise("players")
    history = (target == "teams") & _any_in(F.col("top_text"), HISTORY_WORDS)

    plain = F.btrim(F.regexp_replace(F.regexp_replace(t, RECENT, ""), " +", " "))
    df = df.withColumn("plain", plain)
    strip = lambda c: F.regexp_replace(c, PUNCTUATION, "")
    padded = F.concat(F.lit(" "), F.col("plain"), F.lit(" "))
    sides = F.lit(None)
    for word in reversed(SEPARATORS):
        pattern = f"^(.*?{EDGE}){word}({EDGE}.*)$"
        left, right = strip(F.regexp_extract(padded, pattern, 1)), strip(F.regexp_extract(padded, pattern, 2))
        sides = F.when((left != "") & (right != ""), F.struct(left.alias("left"), right.alias("right"))).otherwise(sides)
    df = df.withColumn("sides", sides)

    name = strip(F.col("plain"))
    for prefix in PREFIXES:
        name = F.regexp_replace(name, f"^{prefix} *", "")
    df = df.withColumn("name", name)

    intent = (
        F.when(is_top_games, "player_top_games")
        .when(is_top & F.col("top_metric").isNotNull() & history, "team_history_ranking")
        .when(is_top & F.col("top_metric").isNotNull(), "ranking")
        .when(is_top, "unknown")
        .when(F.col("sides").isNotNull(), "players_head_to_head_recent_games")
        .when(F.col("name") != "", "player_recent_games")
        .otherwise("unknown")
    )
    df = df.withColumn("intent", intent)
    is_ = lambda *names: F.col("intent").isin(*names)
    h2h, recent, best = is_("players_head_to_head_recent_games"), is_("player_recent_games"), is_("player_top_games")
    ranked = is_("ranking", "team_history_ranking")
    last_n = F.coalesce(_clamped(F.regexp_extract(t, RECENT, 1), most_games), F.lit(RECENT_GAMES_DEFAULT))
    return df.select(
        *questions.columns, "intent",
        F.when(best, F.col("tg.player")).when(h2h, F.col("sides.left")).when(recent, F.col("name")).alias("player_1"),
        F.when(h2h, F.col("sides.right")).alias("player_2"),
        F.when(h2h | recent, last_n).cast("bigint").alias("last_n_games"),
        F.when(ranked, target).alias("ranking_target"),
        F.when(best, F.col("tg.metric")).when(ranked, F.col("top_metric")).alias("metric"),
        F.when(best, _clamped(F.col("tg.n"), most_games))
        .when(ranked, _clamped(F.regexp_extract(t, TOP, 1), most_places)).cast("bigint").alias("top_n"),
    )


# --- players named in questions ---------------------------------------------------------------

GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of a given size."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def name_entries(players: DataFrame, aliases: DataFrame) -> DataFrame:
    """Everything a question's name is looked up in: one entry per player, one per alias."""
    columns = [c for c in ("name", "full_name", "display_name", "player_name", "nickname", "slug") if c in players.columns]
    shown = F.coalesce(*[clean_text(c) for c in columns])
    own = F.filter(F.array(*[F.col(c) for c in columns]), lambda c: c.isNotNull())
    people = players.select(
        F.col("id").alias("player_id"), F.coalesce(F.col(columns[0]), F.lit("")).alias("sort_name"),
        own.alias("own"), shown.alias("shown"),
    )
    direct = people.select(
        F.lit("players").alias("matched_via"), "player_id", "sort_name", F.col("shown").alias("matched_value"),
        F.transform("own", F.lower).alias("texts"), F.transform("own", fold).alias("exact"),
    )
    through = aliases.select("player_id", "alias").filter("alias IS NOT NULL").distinct().join(people, "player_id", "left")
    alias_texts = F.array("alias")
    indirect = through.select(
        F.lit("player_aliases").alias("matched_via"), "player_id", F.coalesce("sort_name", F.lit("")).alias("sort_name"),
        F.col("alias").alias("matched_value"), F.transform(alias_texts, F.lower).alias("texts"),
        F.transform(F.concat(F.coalesce("own", F.array().cast("array<string>")), alias_texts), fold).alias("exact"),
    )
    return direct.unionByName(indirect)


def _player_hits(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """All entries that contain a query text.

    Containment is found through three-letter pieces: a text that contains the query
    contains all pieces of the query, so an equi-join on the query's rarest piece
    misses nothing.
    """
    asked = queries.select(F.col("query").alias("q")).filter("q <> ''").distinct()
    size = F.least(F.length("q"), F.lit(GRAM))
    pieces = asked.select(
        "q", F.explode(F.when(size == GRAM, _grams(F.col("q"), GRAM)).otherwise(F.array("q"))).alias("gram")
    )
    per_text = lambda text: F.array_union(_grams(text, 3), F.array_union(_grams(text, 2), _grams(text, 1)))
    index = entries.withColumn("gram", F.explode(F.array_distinct(F.flatten(F.transform("texts", per_text)))))
    frequency = index.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = pieces.join(frequency, "gram", "left").groupBy("q").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best")
    ).filter("best.n > 0").select("q", F.col("best.gram").alias("gram"))

    hits = rarest.join(index, "gram").filter(F.exists("texts", lambda x: x.contains(F.col("q"))))
    return hits.withColumn("turn", F.when(F.col("matched_via") == "players", 0).otherwise(1)).withColumns({
        "is_exact": F.exists("exact", lambda x: x == F.col("q")), "alias_equal": fold("matched_value") == F.col("q"),
    }).drop("gram", "texts", "exact")


def player_candidates(queries: DataFrame, entries: DataFrame, limit: int = 10) -> DataFrame:
    """Up to ``limit`` players per query text whose name, slug or alias contains it, as a list to show.

    Direct hits come before alias hits; a player counts once.
    """
    hits = _player_hits(queries, entries)
    ranked = top_per_group(
        hits, ["q", "matched_via"], ["sort_name", "player_id", "matched_value"], limit, "place")
    once = top_per_group(ranked, ["q", "player_id"], ["turn", "place"], 1, "copy")
    return top_per_group(once, ["q"], ["turn", "place"], limit, "candidate_rank").select(
        F.col("q").alias("query"), F.col("candidate_rank").cast("bigint").alias("candidate_rank"), "player_id",
        "matched_via", "matched_value", "is_exact", "alias_equal",
    )


SHORT_NAME = 6


def resolve_single_player(queries: DataFrame, players: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per query text: status ok / ambiguous / not_found, the player, and how many players it may mean.

    Decided over all players whose name, slug or alias contains the text, however many.  A
    player found by name is judged by name; one found through aliases only, by any of them.
    """
    hits = _player_hits(queries, name_entries(players, aliases))
    holds = lambda turn, c: F.max(F.when(F.col("turn") == turn, F.coalesce(c, F.lit(False)).cast("int")))
    found = hits.groupBy(F.col("q").alias("query"), "player_id").agg(
        F.min("turn").alias("turn"), holds(1, "alias_equal").alias("alias_equal"),
        holds(0, "is_exact").alias("by_name"), holds(1, "is_exact").alias("through_alias"),
    )
    alias_hit = (F.col("turn") == 1) & (F.col("alias_equal") == 1)
    exact = F.when(F.col("turn") == 0, F.col("by_name")).otherwise(F.col("through_alias")) == 1
    tallied = found.groupBy("query").agg(
        F.count("*").alias("candidates"),
        F.count_if(alias_hit).alias("n_alias"), F.min(F.when(alias_hit, F.col("player_id"))).alias("by_alias"),
        F.count_if(exact).alias("n_exact"), F.min(F.when(exact, F.col("player_id"))).alias("by_exact"),
        F.min("player_id").alias("only"),
    )
    asked = queries.select("query").distinct()
    short = (F.size(F.split("query", " ")) == 1) & (F.length("query") <= SHORT_NAME)
    several = F.col("candidates") > 1
    player = (
        F.when(short & several, None)
        .when(F.col("n_alias") == 1, F.col("by_alias"))
        .when(F.col("n_exact") == 1, F.col("by_exact"))
        .when(F.col("candidates") == 1, F.col("only"))
    )
    status = F.when(F.col("candidates").isNull(), "not_found").when(player.isNotNull(), "ok").otherwise("ambiguous")
    return asked.join(tallied, "query", "left").select(
        "query", status.alias("status"), player.alias("player_id"),
        F.coalesce("candidates", F.lit(0)).cast("bigint").alias("candidates"),
    )


def named_players(parsed: DataFrame, players: DataFrame, aliases: DataFrame) -> DataFrame:
    """Parsed questions with status and id of the players they name.

    Each distinct name is looked up once, however many questions use it.
    """
    both = parsed.select(F.explode(F.array("player_1", "player_2")).alias("query")).filter("query IS NOT NULL")
    resolved = resolve_single_player(both, players, aliases).drop("candidates")
    out = parsed
    for n in (1, 2):
        out = out.join(resolved.toDF(f"player_{n}", f"status_{n}", f"player_id_{n}"), f"player_{n}", "left")
    return out


def answer_status(named: DataFrame) -> DataFrame:
    """What a question gets: ok, needs_clarification, not_found or unsupported."""
    pair = F.col("intent") == "players_head_to_head_recent_games"
    single = F.col("intent").isin("player_recent_games", "player_top_games")
    status = (
        F.when(F.col("intent") == "unknown", "unsupported")
        .when(pair & (F.col("status_1") == "ok") & (F.col("status_2") == "ok"), "ok").when(pair, "needs_clarification")
        .when(single & (F.col("status_1") == "ok"), "ok").when(single & (F.col("status_1") == "not_found"), "not_found")
        .when(single, "needs_clarification").otherwise("ok")
    )
    return named.select("question_id", "intent", status.alias("status"), F.col("player_id_1"), F.col("player_id_2"))


# --- answers ----------------------------------------------------------------------------------


def answer_recent_games(named: DataFrame, stats: DataFrame, games: DataFrame, unique: tuple,
                        most: int = RECENT_GAMES_MAX) -> DataFrame:
    """The newest games of the asked player, with the question's id.

    A question gets as many games as it asks for, ``most`` at the utmost.
    """
    asked = named.filter("intent = 'player_recent_games' AND status_1 = 'ok'").select(
        "question_id", F.col("player_id_1").alias("player_id"), "last_n_games"
    )
    wanted = stats.join(asked.select("player_id").distinct(), "player_id", "left_semi")
    newest = newest_lines_per_player(wanted, games, most, unique)
    return asked.join(newest, "player_id").filter(F.col("game_position") <= F.col("last_n_games"))


def _metric_columns(df: DataFrame, candidates: dict) -> dict[str, str]:
    """The column of each metric that the table has."""
    found = {m: first_present(columns, df.columns) for m, columns in candidates.items()}
    return {m: c for m, c in found.items() if c}


def _asked_value(df: DataFrame, candidates: dict) -> Column:
    """Value of the metric that the row's ``metric`` names."""
    whens = [F.when(F.col("metric") == m, F.col(c).cast("double")) for m, c in _metric_columns(df, candidates).items()]
    return F.coalesce(*whens, F.lit(None).cast("double"))


def _with_asked_metrics(df: DataFrame, asked: DataFrame, candidates: dict, keep: tuple) -> DataFrame:
    """A row per asked metric that the table has.

    The names of the asked metrics, at most those of ``candidates``, are read first: rows
    multiply by what is asked alone, and a scan below reads no other metric's column.
    """
    wanted = {r.metric for r in asked.filter(F.col("metric").isin(*candidates)).select("metric").distinct().collect()}
    columns = {m: c for m, c in _metric_columns(df, candidates).items() if m in wanted}
    if not columns:
        return df.select(*keep, F.lit("").alias("metric"), F.lit(0.0).alias("ranking_value")).limit(0)
    return df.select(*keep, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("ranking_value")) for m, c in columns.items()
    ])))


def answer_top_games(named: DataFrame, stats: DataFrame, games: DataFrame, unique: tuple,
                     most: int = RECENT_GAMES_MAX) -> DataFrame:
    """The asked player's games with the highest value of the asked metric.

    Lines meet only the metrics asked of their player.  A question gets as many games as it
    asks for, ``most`` at the utmost.
    """
    asked = named.filter("intent = 'player_top_games' AND status_1 = 'ok'").select(
        "question_id", F.col("player_id_1").alias("player_id"), "metric", "top_n"
    )
    pairs = asked.select("player_id", "metric").distinct()
    valued = stats.join(pairs, "player_id").withColumn("ranking_value", _asked_value(stats, LINE_COLUMNS))
    rows = player_games(valued.filter("ranking_value IS NOT NULL"), games)
    order = order_existing(rows, ("-ranking_value", *NEWEST_FIRST, *unique), ())
    best = top_per_group(rows, ["player_id", "metric"], order, most, "game_position")
    return asked.join(best, ["player_id", "metric"]).filter(F.col("game_position") <= F.col("top_n"))


def answer_head_to_head(named: DataFrame, stats: DataFrame, games: DataFrame, most: int = RECENT_GAMES_MAX) -> DataFrame:
    """Both players' lines in their newest games against each other.

    The asked players' lines are written once, and the rest reads these.  A pair met where
    both have a line and not all of these lines name one team: then some line of the one
    names another team than some line of the other, or none.  A question gets as many games
    as it asks for, ``most`` at the utmost.
    """
    asked = named.filter(
        "intent = 'players_head_to_head_recent_games' AND status_1 = 'ok' AND status_2 = 'ok'"
    ).select("question_id", "player_id_1", "player_id_2", "last_n_games")
    pair = ["player_id_1", "player_id_2"]
    pairs = asked.select(*pair).distinct()
    roles = pairs.select(*pair, F.posexplode(F.array(*pair)).alias("side", "player_id"))
    lines = cut_lineage(stats.join(roles.select("player_id").distinct(), "player_id", "left_semi"), "asked-lines")

    teams = F.col("team_id")
    met = lines.select("player_id", "game_id", "team_id").join(roles, "player_id").groupBy(*pair, "game_id").agg(
        F.count_distinct("side").alias("sides"), F.min(teams).alias("low"), F.max(teams).alias("high"),
        F.count_if(teams.isNull()).alias("unknown"),
    ).filter((F.col("sides") == 2) & ((F.col("unknown") > 0) | (F.col("low") != F.col("high"))))
    dated = met.select(*pair, "game_id").join(
        games.select(F.col("id").alias("game_id"), F.col("game_date").alias("h2h_date")), "game_id", "left")
    newest = top_per_group(dated, pair, [F.desc("h2h_date"), F.desc("game_id")], most, "game_position")
    chosen = asked.join(newest, pair).filter(F.col("game_position") <= F.col("last_n_games"))
    both = chosen.select("question_id", "game_id", "h2h_date", "game_position",
                         F.explode(F.array_distinct(F.array(*pair))).alias("player_id"))
    return both.join(lines, ["game_id", "player_id"])


def _answer_ranking(asked: DataFrame, table: DataFrame, candidates: dict, keep: tuple, unique: tuple, most: int) -> DataFrame:
    """Each asked metric is ranked once; questions take as many rows as they ask for."""
    valued = _with_asked_metrics(table, asked, candidates, keep).filter("ranking_value IS NOT NULL")
    ranked = top_per_group(valued, ["metric"], [F.desc("ranking_value"), *unique], most, "place")
    return asked.join(ranked, "metric").filter(F.col("place") <= F.col("top_n"))


def answer_ranking(parsed: DataFrame, career: DataFrame, team_seasons: DataFrame, most: int = RANKING_MAX) -> DataFrame:
    """Players by career totals, teams by single seasons; ``most`` rows a question at the utmost."""
    asked = parsed.filter("intent = 'ranking'").select("question_id", "ranking_target", "metric", "top_n")
    players = _answer_ranking(asked.filter("ranking_target = 'players'"), career, CAREER_COLUMNS,
                              ("player_id",), ("player_id",), most)
    teams = _answer_ranking(asked.filter("ranking_target = 'teams'"), team_seasons, LINE_COLUMNS,
                            ("team_id", "season_id", "competition"), ("season_id", "competition", "team_id"), most)
    return players.unionByName(teams, allowMissingColumns=True)


def answer_team_history(parsed: DataFrame, team_seasons: DataFrame, teams: DataFrame, most: int = RANKING_MAX) -> DataFrame:
    """Teams by the sum of the asked metric over all seasons; ``most`` rows a question at the utmost."""
    asked = parsed.filter("intent = 'team_history_ranking'").select("question_id", "ranking_target", "metric", "top_n")
    sums = _with_asked_metrics(team_seasons, asked, LINE_COLUMNS, ("team_id",)).groupBy("team_id", "metric").agg(
        F.sum("ranking_value").alias("ranking_value"), F.count("*").alias("seasons_count")
    )
    ranked = top_per_group(sums, ["metric"], [F.desc_nulls_last("ranking_value"), "team_id"], most, "place")
    return asked.join(ranked, "metric").filter(F.col("place") <= F.col("top_n")).join(team_names(teams), "team_id", "left")
