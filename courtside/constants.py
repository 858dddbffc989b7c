"""Fixed values of the domain: column lists, lookup lists, thresholds.

They decide results, so they are stated here once, as plain lists.
"""

# --- fixed values: statistics -------------------------------------------------

# the 21 counted statistics of a player or team line, in their usual order
STAT_INPUTS = (
    "points", "fg_made", "fg_attempted", "three_made", "three_attempted",
    "two_made", "two_attempted", "ft_made", "ft_attempted",
    "offensive_rebounds", "defensive_rebounds", "total_rebounds", "assists",
    "steals", "blocks", "turnovers", "fouls_committed", "fouls_received",
    "dunks", "plus_minus", "efficiency",
)
MINUTES = "minutes_decimal"

# inputs whose total keeps the input's name; all others get a `_total` suffix
KEEPS_NAME = ("fg_made", "fg_attempted", "three_made", "three_attempted",
              "two_made", "two_attempted", "ft_made", "ft_attempted")
SHORT_TOTALS = {"total_rebounds": "rebounds_total", "minutes_decimal": "minutes_total"}

# statistics that also get a per-game column, and the shooting percentages
PER_GAME = ("minutes", "points", "rebounds", "assists", "steals", "blocks",
            "turnovers", "plus_minus", "efficiency")
SHOTS = ("fg", "three", "two", "ft")

# the eight individual records and their labels
RECORD_STATS = (
    ("points", "Pontos"),
    ("total_rebounds", "Rebotes"),
    ("assists", "Assistências"),
    ("steals", "Roubos"),
    ("blocks", "Tocos"),
    ("three_made", "Bolas de 3 convertidas"),
    ("efficiency", "Eficiência"),
    ("minutes_decimal", "Minutos"),
)

TRUE_WORDS = ("1", "true", "sim", "yes", "y")

# --- fixed values: tables ------------------------------------------------------

TABLES = (
    "seasons", "teams", "team_aliases", "players", "player_aliases", "games",
    "player_game_stats", "team_game_stats", "standings", "team_seasons",
    "player_team_seasons", "player_seasons", "player_career_totals",
    "player_records", "awards", "team_titles",
)

# present and non-empty in a healthy load
REQUIRED_TABLES = ("seasons", "teams", "players", "games", "player_game_stats", "team_game_stats")

# columns of the two tables that are filled in by hand
MANUAL_TABLES = {
    "awards": (
        "id", "season_id", "season_name", "competition", "award_name",
        "award_category", "award_scope", "rank_position", "player_id",
        "player_name_raw", "team_id", "team_name_raw", "position", "notes",
        "source_url",
    ),
    "team_titles": (
        "id", "season_id", "season_name", "competition", "title_name", "team_id",
        "team_name_raw", "opponent_team_id", "opponent_team_name_raw",
        "final_wins", "final_losses", "notes", "source_url",
    ),
}

# --- fixed values: competition ------------------------------------------------

DEFAULT_COMPETITION = "NBB"

# stage key -> (order, label)
STAGES = {
    "nao_classificou": (0, "não classificou"),
    "playoffs": (1, "playoffs"),
    "oitavas": (2, "oitavas"),
    "quartas": (3, "quartas"),
    "semifinal": (4, "semifinal"),
    "vice_campeao": (5, "vice-campeão"),
    "campeao": (6, "campeão"),
}
IN_PROGRESS = "em andamento"
IN_PROGRESS_ORDER = -1

# --- fixed values: ranking metrics ---------------------------------------------

GAMES_COLUMNS = ("games", "games_played", "gp")

# metric key -> (label, candidate columns in order of preference)
PLAYER_METRICS = {
    "points": ("Pontos", ("points", "pts", "total_points", "points_total", "pts_total")),
    "points_per_game": ("Pontos por jogo", ("points_per_game", "ppg", "pts_per_game", "avg_points", "points_avg", "pts_avg")),
    "rebounds": ("Rebotes", ("rebounds", "reb", "total_rebounds", "rebounds_total", "trb")),
    "rebounds_per_game": ("Rebotes por jogo", ("rebounds_per_game", "rpg", "reb_per_game", "avg_rebounds")),
    "assists": ("Assistências", ("assists", "ast", "total_assists", "assists_total")),
    "assists_per_game": ("Assistências por jogo", ("assists_per_game", "apg", "ast_per_game", "avg_assists")),
    "steals": ("Roubos", ("steals", "stl", "total_steals", "steals_total")),
    "steals_per_game": ("Roubos por jogo", ("steals_per_game", "spg", "stl_per_game", "avg_steals")),
    "blocks": ("Tocos", ("blocks", "blk", "total_blocks", "blocks_total")),
    "blocks_per_game": ("Tocos por jogo", ("blocks_per_game", "bpg", "blk_per_game", "avg_blocks")),
    "efficiency": ("Eficiência", ("efficiency", "eff", "total_efficiency", "efficiency_total")),
    "efficiency_per_game": ("Eficiência por jogo", ("efficiency_per_game", "eff_per_game", "avg_efficiency")),
    "minutes": ("Minutos", ("minutes", "min", "minutes_played", "total_minutes", "minutes_total")),
    "games": ("Jogos", GAMES_COLUMNS),
}
TEAM_METRICS = {
    "wins": ("Vitórias", ("wins", "w")),
    "losses": ("Derrotas", ("losses", "l")),
    "points": ("Pontos marcados", ("points", "pts", "points_for", "pf", "total_points", "points_total")),
    "points_per_game": ("Pontos marcados por jogo", ("points_per_game", "ppg", "points_for_per_game", "pf_per_game")),
    "points_against": ("Pontos sofridos", ("points_against", "pa", "points_allowed", "total_points_against")),
    "rebounds": ("Rebotes", ("rebounds", "reb", "total_rebounds", "rebounds_total")),
    "rebounds_per_game": ("Rebotes por jogo", ("rebounds_per_game", "rpg", "reb_per_game", "avg_rebounds")),
    "assists": ("Assistências", ("assists", "ast", "total_assists", "assists_total")),
    "assists_per_game": ("Assistências por jogo", ("assists_per_game", "apg", "ast_per_game", "avg_assists")),
    "steals": ("Roubos", ("steals", "stl", "total_steals", "steals_total")),
    "steals_per_game": ("Roubos por jogo", ("steals_per_game", "spg", "stl_per_game", "avg_steals")),
    "blocks": ("Tocos", ("blocks", "blk", "total_blocks", "blocks_total")),
    "blocks_per_game": ("Tocos por jogo", ("blocks_per_game", "bpg", "blk_per_game", "avg_blocks")),
    "efficiency": ("Eficiência", ("efficiency", "eff", "total_efficiency", "efficiency_total")),
    "efficiency_per_game": ("Eficiência por jogo", ("efficiency_per_game", "eff_per_game", "avg_efficiency")),
    "games": ("Jogos", GAMES_COLUMNS),
}

# --- fixed values: questions ----------------------------------------------------

# words of a question -> metric; compared with accent-free lower-case text
METRIC_WORDS = {
    "points": ("pontos", "ponto", "pts", "pontuacao"),
    "rebounds": ("rebotes", "rebote", "reb"),
    "assists": ("assistencias", "assistencia", "ast"),
    "steals": ("roubos", "roubo", "stl"),
    "blocks": ("tocos", "toco", "blocks", "blk"),
    "efficiency": ("eficiencia", "eff"),
    "minutes": ("minutos", "minuto", "min"),
    "dunks": ("enterradas", "enterrada", "dunks", "cravadas", "cravada"),
    "turnovers": ("turnovers", "erros"),
    "fouls_committed": ("faltas",),
    "games": ("jogos", "partidas"),
    "wins": ("vitorias",),
    "losses": ("derrotas",),
}

# metric -> candidate columns when a question asks for career totals
CAREER_COLUMNS = {
    "points": ("points_total", "total_points", "pts_total", "points", "pts"),
    "rebounds": ("rebounds_total", "total_rebounds", "rebounds", "reb", "trb"),
    "assists": ("assists_total", "total_assists", "assists", "ast"),
    "steals": ("steals_total", "total_steals", "steals", "stl"),
    "blocks": ("blocks_total", "total_blocks", "blocks", "blk"),
    "efficiency": ("efficiency_total", "total_efficiency", "efficiency", "eff"),
    "minutes": ("minutes_total", "total_minutes", "minutes", "min", "minutes_played"),
    "dunks": ("dunks_total", "total_dunks", "dunks", "dunk"),
    "turnovers": ("turnovers_total", "total_turnovers", "turnovers", "tov"),
    "fouls_committed": ("fouls_committed_total", "total_fouls_committed", "fouls_committed"),
    "games": ("games_played", "games", "gp"),
    "wins": ("wins", "w"),
    "losses": ("losses", "l"),
}
# ... and when it asks for one game or one season
LINE_COLUMNS = {
    "points": ("points", "pts", "points_total", "total_points", "pts_total"),
    "rebounds": ("rebounds", "reb", "total_rebounds", "rebounds_total", "trb"),
    "assists": ("assists", "ast", "total_assists", "assists_total"),
    "steals": ("steals", "stl", "total_steals", "steals_total"),
    "blocks": ("blocks", "blk", "total_blocks", "blocks_total"),
    "efficiency": ("efficiency", "eff", "total_efficiency", "efficiency_total"),
    "minutes": ("minutes", "min", "minutes_played", "total_minutes", "minutes_decimal", "minutes_total"),
    "dunks": ("dunks", "dunk", "dunks_total", "total_dunks"),
    "turnovers": ("turnovers", "tov", "turnovers_total", "total_turnovers"),
    "fouls_committed": ("fouls_committed", "fouls_committed_total", "total_fouls_committed"),
    "games": ("games", "games_played", "gp"),
    "wins": ("wins", "w"),
    "losses": ("losses", "l"),
}

RECENT_GAMES_DEFAULT = 5
RECENT_GAMES_MAX = 50
RANKING_MAX = 200

# --- fixed values: grammar of questions -----------------------------------------

RECENT = r"\b(?:ultimos|ultimas|last)\s+(\d+)\s+(?:jogos|games|partidas)\b"
# pattern, group of the player, group of the metric
TOP_GAMES = (
    (r"\btop\s+(\d+)\s+(?:jogos|partidas)\s+com\s+mais\s+(.+?)\s+d[oea]\s+(.+)$", 3, 2),
    (r"\btop\s+(\d+)\s+(?:jogos|partidas)\s+d[oea]\s+(.+?)\s+com\s+mais\s+(.+)$", 2, 3),
)
TOP = r"\btop\s+(\d+)\s+(.+)"
TEAM_WORDS = ("time", "equipes")
HISTORY_WORDS = ("historia", "historico", "carreira", "todos os tempos")
SEPARATORS = ("vs", "versus", "contra")
# removed one after the other from the front of a player question
PREFIXES = ("jogos de", "jogos do", "jogos da", "estatisticas de", "stats de", "ultimos jogos de")

# --- fixed values: pages and paging ---------------------------------------------

PAGE_DEFAULT = 50
PAGE_MAX = 1000

SEARCH_COLUMNS = {
    "players": ("name", "full_name", "slug", "nickname", "birthplace", "position"),
    "teams": ("name", "slug", "city", "state", "short_name", "abbreviation"),
    "games": ("game_date", "date", "phase", "stage", "round", "arena", "venue", "city",
              "home_team_name", "away_team_name", "boxscore_url", "source_url"),
    "seasons": ("name", "slug", "start_year", "end_year"),
}
SEARCH_ORDER = {
    "players": ("name", "full_name", "id"),
    "teams": ("name", "id"),
    "games": ("game_date", "date", "id"),
    "seasons": ("start_year", "id"),
}

# columns left out of a team's history sums
HISTORY_EXCLUDED = ("id", "team_id", "season_id")
HISTORY_EXCLUDED_PARTS = ("name", "slug", "url", "date", "phase", "stage", "round",
                          "arena", "venue", "city", "state")

# --- fixed values: name resolution ----------------------------------------------

SUGGEST_MIN_SIMILARITY = 720     # per mille
REVIEW_MIN_SCORE = 65
REVIEW_TOP = 8
JERSEY_MIN_SCORE = 0.88
# points added or taken per context field: (match, mismatch)
SUGGEST_WEIGHTS = {"season_id": (25, 0), "team_id": (30, -45), "jersey_number": (20, -20)}
REVIEW_WEIGHTS = {"season_id": (35, -15), "team_id": (45, -60), "jersey_number": (30, -25)}
# (score at least, margin at least) for an automatic decision
AUTO_RULES = ((130, 12), (150, 6))

# --- fixed values: type inference by column name ---------------------------------

INTEGER_NAMES = (
    "id", "season_id", "team_id", "home_team_id", "away_team_id",
    "opponent_team_id", "player_id", "game_id", "rank", "wins", "losses",
    "games", "games_played", "start_year", "end_year", "year",
    "jersey_number", "is_current", "is_champion",
)
REAL_PARTS = ("pct", "percentage", "percent", "avg", "average", "per_game",
              "rating", "eff", "efficiency", "minutes", "min")

# fixed values: words that name a stage, narrowest first ("Quartas de final" is not a final)
STAGE_WORDS = (
    ("semi", "semifinal"),
    ("quarta", "quartas"),
    ("oitava", "oitavas"),
    ("final", "final"),
    ("playoff", "playoffs"),
    ("mata mata", "playoffs"),
    ("mata-mata", "playoffs"),
)
