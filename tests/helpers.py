"""Small random seasons and plain-Python answers to compare with."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

SCHEMA = (
    "fixture_id long, competition_id long, season_id long, home_team_id long, away_team_id long, "
    "kickoff timestamp, status string, home_goals long, away_goals long"
)
START = datetime(2020, 1, 3, 12, tzinfo=UTC)


def season(seed: int, n: int, teams: int = 6, hot: float = 0.0, crowd: int = 0, leagues: int = 2):
    """Random matches over about a year with shared instants; ``hot`` gives one league that share of rows.

    ``crowd`` adds that many matches between two teams at one instant.
    """
    r = random.Random(seed)
    rows = []
    for i in range(n):
        comp = 1 if r.random() < hot else r.randint(1, leagues)
        h, a = r.sample(range(teams), 2)
        at = START + timedelta(days=r.randint(0, 330), hours=r.randint(0, 3))
        rows.append((i + 1, comp, 2020, comp * 100 + h, comp * 100 + a, at, "finished", r.randint(0, 4), r.randint(0, 3)))
    for j in range(crowd):
        at = START + timedelta(days=100)
        rows.append((n + j + 1, 1, 2020, 100, 101, at, "finished", r.randint(0, 4), r.randint(0, 3)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def history(rows, comp, team, at, venue=None):
    """Earlier matches of a team, newest first; ties by id."""
    out = []
    for fid, c, _s, h, a, k, _st, hg, ag in rows:
        if c == comp and k < at and team in (h, a):
            home = team == h
            if venue is None or venue == home:
                gf, ga = (hg, ag) if home else (ag, hg)
                out.append((k, fid, gf, ga))
    return sorted(out, key=lambda x: (-x[0].timestamp(), x[1]))


def elo(rows, k=20.0, hfa=65.0):
    """Pre-match ratings per match id: all matches of an instant read the ratings before it."""
    out = {}
    for comp in {x[1] for x in rows}:
        ordered = sorted((x for x in rows if x[1] == comp), key=lambda x: (x[5], x[0]))
        ratings = {}
        i = 0
        while i < len(ordered):
            j = i
            while j < len(ordered) and ordered[j][5] == ordered[i][5]:
                x = ordered[j]
                out[x[0]] = (ratings.get(x[3], 1500.0), ratings.get(x[4], 1500.0))
                j += 1
            for x in ordered[i:j]:
                rh, ra = ratings.get(x[3], 1500.0), ratings.get(x[4], 1500.0)
                e = 1.0 / (1.0 + 10.0 ** ((ra - (rh + hfa)) / 400.0))
                s = 1.0 if x[7] > x[8] else 0.0 if x[7] < x[8] else 0.5
                ratings[x[3]] = rh + k * (s - e)
                ratings[x[4]] = ra + k * ((1 - s) - (1 - e))
            i = j
    return out


def table(rows, comp, at):
    """Ordered table of a league from matches before an instant: team -> (position, points, difference)."""
    tot = {}
    for _f, c, _s, h, a, k, _st, hg, ag in rows:
        if c != comp or k >= at:
            continue
        for t, gf, ga in ((h, hg, ag), (a, ag, hg)):
            p, g, x = tot.get(t, (0, 0, 0))
            tot[t] = (p + (3 if gf > ga else 1 if gf == ga else 0), g + gf, x + ga)
    order = sorted(tot, key=lambda t: (-tot[t][0], -(tot[t][1] - tot[t][2]), -tot[t][1], t))
    return {t: (i + 1, tot[t][0], tot[t][1] - tot[t][2]) for i, t in enumerate(order)}
