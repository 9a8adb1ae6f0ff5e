"""Independent SQL (DuckDB dialect) for the registered queries.

Written from the operator definitions, not generated from the Spark plans:
the read view, the trim, the windows and the binning are spelled out again
so that a second engine checks the first.  Tables ``events`` etc. are views.
"""

from __future__ import annotations

import math

# The read table from `events` and the merged/enriched read view.
READS = r"""
WITH ev AS (
  SELECT CAST(event_id AS VARCHAR) AS read_id, event_type AS run_id, 'S1' AS sample_id, event_id AS read,
         CAST(user_id % 3000 + 1 AS INTEGER) AS channel, ts AS start_time_utc,
         CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS start_time_float,
         CAST(regexp_extract(props, '"k":\s*(\d+)', 1) AS BIGINT) * 100 AS num_events,
         CAST(event_id % 97 AS DOUBLE) / CAST(10 AS DOUBLE) AS template_duration,
         CAST(floor(value * 100 + 0.5) AS BIGINT) AS sequence_length_template,
         CASE WHEN event_id % 211 = 0 THEN NULL
              ELSE CAST((event_id * 7919) % 1500 AS DOUBLE) / CAST(100 AS DOUBLE) END AS mean_qscore_template
  FROM events),
fq AS (
  SELECT CASE WHEN read % 13 = 0 THEN read_id || '-x' ELSE read_id END AS read_id,
         run_id, sample_id, read, channel, start_time_utc
  FROM ev),
merged AS (
  SELECT s.read_id, s.run_id, s.channel, s.start_time_float, s.num_events, s.template_duration,
         s.sequence_length_template, s.mean_qscore_template, f.sample_id, f.read, f.start_time_utc
  FROM ev s JOIN fq f ON s.read_id = f.read_id AND s.run_id = f.run_id AND s.channel = f.channel),
reads AS (
  SELECT *,
         CAST(epoch_us(start_time_utc) - min(epoch_us(start_time_utc)) OVER () AS DOUBLE) / 1e6
           AS start_time_float_by_sample,
         coalesce(mean_qscore_template > 9, false) AS pass,
         CASE WHEN coalesce(mean_qscore_template > 9, false) THEN 'Passed' ELSE 'Failed' END AS qualitative_pass,
         CAST(sequence_length_template AS DOUBLE) / nullif(template_duration, 0) AS pore_speed,
         CAST(num_events AS DOUBLE) / nullif(CAST(sequence_length_template AS DOUBLE), 0) AS events_ratio
  FROM merged)
"""

TRIM = r"""
, bnd AS (
  SELECT trunc(quantile_cont(sequence_length_template, 0.999)) AS lmax,
         trunc(quantile_cont(start_time_float_by_sample, 0.001)) AS tmin,
         trunc(quantile_cont(start_time_float_by_sample, 0.999)) AS tmax
  FROM reads),
trimmed0 AS (
  SELECT r.* FROM reads r, bnd
  WHERE r.sequence_length_template < bnd.lmax AND r.events_ratio < 20
    AND r.start_time_float_by_sample > bnd.tmin AND r.start_time_float_by_sample < bnd.tmax),
trimmed AS (
  SELECT * EXCLUDE (start_time_float_by_sample),
         CAST(epoch_us(start_time_utc) - min(epoch_us(start_time_utc)) OVER () AS DOUBLE) / 1e6
           AS start_time_float_by_sample
  FROM trimmed0)
"""

BASE = READS + TRIM


def _qtrim(src: str, p: float, name: str) -> str:
    return f""", {name} AS (
  SELECT * FROM {src}
  WHERE sequence_length_template < (SELECT trunc(quantile_cont(sequence_length_template, {p})) FROM {src}))
"""


def _hist(src: str, col: str, bins: str | None, weight: str = "1.0", lower: str | None = None,
          by: str | None = None, name: str = "h") -> str:
    """Equal-width histogram CTEs ending in ``{name}`` with columns
    (by?, bin, left_e, right_e, w, density)."""
    byc = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    if bins is None:
        nb = ("least(CAST(CASE WHEN n < 2 THEN 1 "
              "WHEN coalesce(2 * iqr / pow(CAST(n AS DOUBLE), CAST(1 AS DOUBLE) / 3), 0) = 0 THEN floor(sqrt(CAST(n AS DOUBLE))) "
              "ELSE ceil((mx - mn) / (2 * iqr / pow(CAST(n AS DOUBLE), CAST(1 AS DOUBLE) / 3))) END AS BIGINT), 50)")
    else:
        nb = f"CAST({bins} AS BIGINT)"
    mn = lower if lower is not None else "mn"
    join = f"JOIN {name}_p USING ({by})" if by else f"CROSS JOIN {name}_p"
    return f""", {name}_d AS (
  SELECT {byc}x, w FROM (SELECT {byc}CAST({col} AS DOUBLE) AS x, CAST({weight} AS DOUBLE) AS w FROM {src})
  WHERE x IS NOT NULL AND NOT isnan(x) AND w IS NOT NULL),
{name}_s AS (
  SELECT {byc}min(x) AS mn, max(x) AS mx, count(*) AS n, sum(w) AS tw,
         quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr
  FROM {name}_d {grp}),
{name}_p AS (
  SELECT {byc}tw, CASE WHEN mx = {mn} THEN {mn} - 0.5 ELSE {mn} END AS lo,
         CASE WHEN mx = {mn} THEN mx + 0.5 ELSE mx END AS hi, greatest({nb}, 1) AS nb
  FROM {name}_s),
{name}_q AS (SELECT *, (hi - lo) / CAST(nb AS DOUBLE) AS step FROM {name}_p),
{name}_r AS (
  SELECT d.*, q.lo, q.hi, q.nb, q.step,
         least(greatest(CAST(floor((d.x - q.lo) / q.step) AS BIGINT), 0), q.nb - 1) AS raw
  FROM {name}_d d {join.replace(f'{name}_p', f'{name}_q q')}
  WHERE d.x >= q.lo AND d.x <= q.hi),
{name}_r2 AS (
  SELECT *, CASE WHEN raw > 0 AND x < (CASE WHEN raw >= nb THEN hi ELSE CAST(raw AS DOUBLE) * step + lo END)
                 THEN raw - 1 ELSE raw END AS dn
  FROM {name}_r),
{name}_b AS (
  SELECT {byc}CASE WHEN dn < nb - 1 AND x >= (CASE WHEN dn + 1 >= nb THEN hi ELSE CAST(dn + 1 AS DOUBLE) * step + lo END)
                   THEN dn + 1 ELSE dn END AS bin, w
  FROM {name}_r2),
{name}_sum AS (SELECT {byc}bin, sum(w) AS w FROM {name}_b GROUP BY {byc}bin),
{name}_all AS (SELECT {byc}lo, hi, step, nb, tw, unnest(range(nb)) AS bin FROM {name}_q),
{name} AS (
  SELECT {"a." + by + ", " if by else ""}a.bin, CAST(a.bin AS DOUBLE) * a.step + a.lo AS left_e,
         CASE WHEN a.bin + 1 >= a.nb THEN a.hi ELSE CAST(a.bin + 1 AS DOUBLE) * a.step + a.lo END AS right_e,
         coalesce(s.w, 0) AS w, coalesce(s.w, 0) / (a.tw * a.step) AS density
  FROM {name}_all a LEFT JOIN {name}_sum s ON a.bin = s.bin {f"AND a.{by} = s.{by}" if by else ""})
"""


def _kde(src: str, col: str, by: str | None = None, name: str = "k") -> str:
    """Gaussian KDE CTEs ending in ``{name}`` with (by?, point, gx, density)."""
    byc = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    join = f"JOIN {name}_g USING ({by})" if by else f"CROSS JOIN {name}_g"
    return f""", {name}_d AS (
  SELECT {byc}x FROM (SELECT {byc}CAST({col} AS DOUBLE) AS x FROM {src}) WHERE x IS NOT NULL AND NOT isnan(x)),
{name}_s AS (
  SELECT {byc}count(*) AS n, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx,
         quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr
  FROM {name}_d {grp}),
{name}_b AS (
  SELECT *, 1.059 * (CASE WHEN iqr > 0 THEN least(sd, iqr / 1.349) ELSE sd END) * pow(CAST(n AS DOUBLE), -0.2) AS bw
  FROM {name}_s),
{name}_g AS (
  SELECT {byc}n, bw, point, (mn - 3 * bw) + CAST(point AS DOUBLE) * (((mx + 3 * bw) - (mn - 3 * bw)) / 99) AS gx
  FROM {name}_b CROSS JOIN range(100) t(point)
  WHERE bw IS NOT NULL AND bw > 0),
{name}_h AS (SELECT {byc}x, count(*) AS c FROM {name}_d GROUP BY {byc}x),
{name} AS (
  SELECT {byc}point, gx, sum(c * exp(-0.5 * ((gx - x) / bw) * ((gx - x) / bw))) / (n * bw * sqrt(2 * pi())) AS density
  FROM {name}_h {join}
  GROUP BY {byc}point, gx, n, bw)
"""


def _poisson_limits() -> str:
    """Cumulative Poisson(1) odds on the scale of the draws."""
    odds, limits, term = 0.0, [], math.exp(-1)
    for k in range(10):
        odds += term
        limits.append(math.floor(odds * 2147483647))
        term /= k + 1
    return " + ".join(f"CAST(r >= {t} AS INTEGER)" for t in limits)


def _trend_rows(src: str, y: str) -> str:
    """Rows at their nearest percentile point, and the weighted sums of 200 replicates."""
    probs = ", ".join(repr(k / 11) for k in range(1, 11))
    return BASE + f""", td AS (
  SELECT qualitative_pass AS "group", start_time_float_by_sample AS x, CAST({y} AS DOUBLE) AS y,
         md5('bootstrap-1:' || read_id) AS h FROM {src}
  WHERE start_time_float_by_sample IS NOT NULL AND {y} IS NOT NULL AND NOT isnan({y})),
cen AS (SELECT "group", quantile_cont(x, [{probs}]) AS cl FROM td GROUP BY "group"),
tb AS (
  SELECT td.*, cen.cl[5] AS origin, cen.cl[1 + len(list_filter(list_transform(range(1, 10), lambda i: (cen.cl[i] + cen.cl[i + 1]) / 2), lambda m: m < td.x))] AS x_centre
  FROM td JOIN cen USING ("group")),
co AS (
  SELECT b, CAST('0x' || substr(md5('a:' || b), 1, 8) AS BIGINT) % 2147483646 + 1 AS a,
         CAST('0x' || substr(md5('c:' || b), 1, 8) AS BIGINT) % 2147483646 + 1 AS c FROM range(200) t(b)),
dr AS (
  SELECT "group", x_centre, origin, x - origin AS x, y, b,
         (CAST('0x' || substr(h, 1, 8) AS BIGINT) % 2147483647 * a % 2147483647
          + CAST('0x' || substr(h, 9, 8) AS BIGINT) % 2147483647 * c % 2147483647) % 2147483647 AS r
  FROM tb CROSS JOIN co),
bs AS (
  SELECT "group", x_centre, origin, b, sum(w) AS w, sum(w * x) AS wx, sum(w * y) AS wy, sum(w * x * x) AS wxx, sum(w * x * y) AS wxy
  FROM (SELECT *, {_poisson_limits()} AS w FROM dr) GROUP BY ALL)
"""


def _trend(src: str, y: str) -> str:
    return _trend_rows(src, y) + f""",
pb AS (SELECT "group", x_centre, count(*) AS reads, avg(y) AS y_mean FROM tb GROUP BY "group", x_centre),
ci AS (SELECT "group", x_centre, quantile_cont(wy / w, [0.025, 0.975]) AS q FROM bs WHERE w > 0 GROUP BY "group", x_centre),
ln AS (SELECT "group", regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM td GROUP BY "group"),
lim AS (SELECT 2 * avg(CAST({y} AS DOUBLE)) AS y_axis_max FROM {src} WHERE NOT isnan(CAST({y} AS DOUBLE)))
SELECT pb."group", round(x_centre, 6) AS x_centre, reads, round(y_mean, 6) AS y_mean,
       round(q[1], 6) AS ci_low, round(q[2], 6) AS ci_high,
       round(slope, 12) AS slope, round(intercept, 6) AS intercept, round(y_axis_max, 6) AS y_axis_max
FROM pb JOIN ln USING ("group") JOIN ci USING ("group", x_centre) CROSS JOIN lim
"""


def _band(src: str, y: str) -> str:
    return _trend_rows(src, y) + """,
rl AS (
  SELECT "group", origin, b, sum(w) AS w, sum(wx) AS wx, sum(wy) AS wy, sum(wxx) AS wxx, sum(wxy) AS wxy FROM bs GROUP BY ALL),
ra AS (
  SELECT "group", origin, (w * wxy - wx * wy) / (w * wxx - wx * wx) AS slope, wx / w AS mx, wy / w AS my
  FROM rl WHERE w * wxx - wx * wx > 0),
en AS (
  SELECT "group", min(x) AS lo, max(x) AS hi, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM td GROUP BY "group"),
gp AS (SELECT en.*, CAST(k AS INTEGER) AS point, lo + k * ((hi - lo) / 99) AS gx FROM en CROSS JOIN range(100) t(k)),
gy AS (
  SELECT "group", point, gx, gp.intercept + gp.slope * gx AS y_fit,
         quantile_cont(my + ra.slope * (gx - origin - mx), [0.025, 0.975]) AS q
  FROM gp JOIN ra USING ("group") GROUP BY ALL)
SELECT "group", point, round(gx, 6) AS x, round(y_fit, 6) AS y_fit, round(q[1], 6) AS y_low, round(q[2], 6) AS y_high FROM gy
"""


def _hexbin(src: str, x: str, y: str) -> str:
    return f""", hx AS (
  SELECT CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {src}
  WHERE {x} IS NOT NULL AND {y} IS NOT NULL AND NOT isnan(CAST({x} AS DOUBLE)) AND NOT isnan(CAST({y} AS DOUBLE))),
hs AS (
  SELECT count(*) AS n, min(x) AS xmn, max(x) AS xmx, min(y) AS ymn, max(y) AS ymx,
         quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS xiqr, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS yiqr
  FROM hx),
hf AS (
  SELECT *,
    least(CASE WHEN n < 2 THEN 1 WHEN 2 * xiqr / pow(CAST(n AS DOUBLE), CAST(1 AS DOUBLE) / 3) = 0 THEN CAST(floor(sqrt(CAST(n AS DOUBLE))) AS BIGINT)
          ELSE CAST(ceil((xmx - xmn) / (2 * xiqr / pow(CAST(n AS DOUBLE), CAST(1 AS DOUBLE) / 3))) AS BIGINT) END, 50) AS xb,
    least(CASE WHEN n < 2 THEN 1 WHEN 2 * yiqr / pow(CAST(n AS DOUBLE), CAST(1 AS DOUBLE) / 3) = 0 THEN CAST(floor(sqrt(CAST(n AS DOUBLE))) AS BIGINT)
          ELSE CAST(ceil((ymx - ymn) / (2 * yiqr / pow(CAST(n AS DOUBLE), CAST(1 AS DOUBLE) / 3))) AS BIGINT) END, 50) AS yb
  FROM hs),
hg AS (
  SELECT *, greatest(CAST(floor((xb + yb) / 2) AS BIGINT), 1) AS nx FROM hf),
hg2 AS (
  SELECT *, greatest(CAST(floor(nx / sqrt(3)) AS BIGINT), 1) AS ny,
         xmn - 1.0e-9 * (xmx - xmn) AS x0, xmx + 1.0e-9 * (xmx - xmn) AS x1 FROM hg),
hp AS (SELECT *, (x1 - x0) / nx AS sx, (ymx - ymn) / ny AS sy FROM hg2),
hi AS (SELECT (hx.x - hp.x0) / hp.sx AS ix, (hx.y - hp.ymn) / hp.sy AS iy, hp.nx, hp.ny, hp.x0, hp.ymn, hp.sx, hp.sy FROM hx CROSS JOIN hp),
hj AS (SELECT *, CAST(round_even(ix, 0) AS BIGINT) AS ix1, CAST(round_even(iy, 0) AS BIGINT) AS iy1,
              CAST(floor(ix) AS BIGINT) AS ix2, CAST(floor(iy) AS BIGINT) AS iy2 FROM hi),
hk AS (
  SELECT *, ((ix - ix1) * (ix - ix1) + 3.0 * ((iy - iy1) * (iy - iy1))) < ((ix - ix2 - 0.5) * (ix - ix2 - 0.5) + 3.0 * ((iy - iy2 - 0.5) * (iy - iy2 - 0.5))) AS first
  FROM hj),
hc AS (
  SELECT CASE WHEN first THEN 1 ELSE 2 END AS lattice, CASE WHEN first THEN ix1 ELSE ix2 END AS i,
         CASE WHEN first THEN iy1 ELSE iy2 END AS j, nx, ny, x0, ymn, sx, sy
  FROM hk)
SELECT lattice, i, j,
       round(x0 + (CAST(i AS DOUBLE) + CASE WHEN lattice = 1 THEN 0.0 ELSE 0.5 END) * sx, 6) AS x_centre,
       round(ymn + (CAST(j AS DOUBLE) + CASE WHEN lattice = 1 THEN 0.0 ELSE 0.5 END) * sy, 6) AS y_centre,
       count(*) AS reads
FROM hc
WHERE (lattice = 1 AND i >= 0 AND i < nx + 1 AND j >= 0 AND j < ny + 1)
   OR (lattice = 2 AND i >= 0 AND i < nx AND j >= 0 AND j < ny)
GROUP BY lattice, i, j, x0, ymn, sx, sy
"""


def _hhmm(x: str) -> str:
    return (f"CASE WHEN {x} = 0 THEN '0' ELSE printf('%02d:%02d', CAST(floor({x} / 3600) AS BIGINT), "
            f"CAST(floor(fmod({x}, 3600) / 60) AS BIGINT)) END")


def _round_frac(x: str) -> str:
    sig = f"(CAST(-floor(log10(abs({x}))) - 1 + 3 AS DOUBLE))"
    scale = f"(CASE WHEN floor(abs({x})) = 0 THEN pow(10.0, {sig}) ELSE 1000.0 END)"
    return f"(CASE WHEN {x} = 0 THEN {x} ELSE round_even({x} * {scale}, 0) / {scale} END)"


def _ridges() -> str:
    edge = lambda i: (f"(CASE WHEN {i} <= 0 THEN mn - (mx - mn) * 0.001 WHEN {i} >= 16 THEN mx "  # noqa: E731
                      f"ELSE CAST({i} AS DOUBLE) * ((mx - mn) / 16) + mn END)")
    return BASE + f""", rs AS (SELECT min(start_time_float_by_sample) AS mn, max(start_time_float_by_sample) AS mx FROM trimmed),
r0 AS (
  SELECT t.mean_qscore_template, t.start_time_float_by_sample AS x, rs.mn, rs.mx,
         CASE WHEN (rs.mx - rs.mn) / 16 = 0 THEN 0
              ELSE least(greatest(CAST(ceil((t.start_time_float_by_sample - rs.mn) / ((rs.mx - rs.mn) / 16)) AS INTEGER) - 1, 0), 15) END AS raw
  FROM trimmed t CROSS JOIN rs),
r1 AS (SELECT *, CASE WHEN raw > 0 AND x <= {edge('raw')} THEN raw - 1 ELSE raw END AS dn FROM r0),
r2 AS (SELECT *, CASE WHEN dn < 15 AND x > {edge('dn + 1')} THEN dn + 1 ELSE dn END AS time_bin FROM r1),
r3 AS (
  SELECT *, greatest({_round_frac(edge('time_bin'))}, 0.0) AS lft, least({_round_frac(edge('time_bin + 1'))}, mx) AS rgt FROM r2),
rq AS (SELECT {_hhmm('lft')} || ' - ' || {_hhmm('rgt')} AS time_bin_label, mean_qscore_template FROM r3)
{_kde('rq', 'mean_qscore_template', by='time_bin_label')}
SELECT time_bin_label, CAST(point AS INTEGER) AS point, round(gx, 6) AS x, round(density, 12) AS density FROM k
"""


def _curve(measure: str, value: str, by_quality: bool) -> str:
    parts = [f"SELECT 'All' AS series, CAST(floor(start_time_float_by_sample / 60.0) AS BIGINT) AS time_bin, {measure} AS v "
             f"FROM trimmed GROUP BY 2"]
    if by_quality:
        parts.append(f"SELECT qualitative_pass AS series, CAST(floor(start_time_float_by_sample / 60.0) AS BIGINT) AS time_bin, "
                     f"{measure} AS v FROM trimmed GROUP BY 1, 2")
    union = " UNION ALL ".join(parts)
    return BASE + f""", cb AS ({union})
SELECT series, time_bin, round(CAST(time_bin AS DOUBLE) * 60.0, 6) AS time_s, CAST(v AS BIGINT) AS {value}_in_bin,
       CAST(sum(v) OVER (PARTITION BY series ORDER BY time_bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS {value}
FROM cb
"""


def _describe(col: str, src: str = "reads") -> str:
    return f"""
SELECT stat, round(value, 2) AS value FROM (
  SELECT 'count' AS stat, CAST(count({col}) AS DOUBLE) AS value FROM {src}
  UNION ALL SELECT 'mean', avg(CAST({col} AS DOUBLE)) FROM {src}
  UNION ALL SELECT 'std', stddev_samp(CAST({col} AS DOUBLE)) FROM {src}
  UNION ALL SELECT 'min', min(CAST({col} AS DOUBLE)) FROM {src}
  UNION ALL SELECT '10%', quantile_cont(CAST({col} AS DOUBLE), 0.1) FROM {src}
  UNION ALL SELECT '25%', quantile_cont(CAST({col} AS DOUBLE), 0.25) FROM {src}
  UNION ALL SELECT '50%', quantile_cont(CAST({col} AS DOUBLE), 0.5) FROM {src}
  UNION ALL SELECT '75%', quantile_cont(CAST({col} AS DOUBLE), 0.75) FROM {src}
  UNION ALL SELECT '90%', quantile_cont(CAST({col} AS DOUBLE), 0.9) FROM {src}
  UNION ALL SELECT 'max', max(CAST({col} AS DOUBLE)) FROM {src})
"""


def _human(n: str) -> str:
    """Decimal human text of a base count, half-up on the exact ratio (see functions.expr.human_bases)."""
    expr = f"CAST({n} AS VARCHAR) || 'b'"
    for i, prefix in enumerate(["K", "M", "G", "T", "P", "E"]):
        d = 1000 ** (i + 1)
        hund = f"((CAST({n} AS HUGEINT) * 100 + {d // 2}) // {d})"
        whole = f"({hund} // 100)"
        frac = f"({hund} % 100)"
        text = (f"(CASE WHEN {frac} = 0 THEN CAST({whole} AS VARCHAR) "
                f"WHEN {frac} % 10 = 0 THEN CAST({whole} AS VARCHAR) || '.' || CAST({frac} // 10 AS VARCHAR) "
                f"ELSE CAST({whole} AS VARCHAR) || '.' || lpad(CAST({frac} AS VARCHAR), 2, '0') END)")
        expr = f"(CASE WHEN {n} >= {d} THEN {text} || ' {prefix}b' ELSE {expr} END)"
    return expr


def _nx_compat(src: str, s: str = "") -> str:
    """CTEs ending in ``nx{s}(label, value)``: target after target, the first read past the previous
    pick whose cumulative bases do not exceed the target while the next read's reach it."""
    out = f""", ns{s} AS (
  SELECT sequence_length_template AS len,
         sum(sequence_length_template) OVER (ORDER BY sequence_length_template ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
         row_number() OVER (ORDER BY sequence_length_template) - 1 AS idx
  FROM {src} WHERE sequence_length_template IS NOT NULL),
nn{s} AS (SELECT *, lead(cum) OVER (ORDER BY idx) AS nxt FROM ns{s}),
tot{s} AS (SELECT CAST(sum(sequence_length_template) AS DOUBLE) AS t FROM {src})"""
    labels = []
    for j, p in enumerate((0.1, 0.25, 0.5, 0.75, 0.9)):
        before = f", hit{s}_{j - 1} h" if j else ""
        past = "AND nn.idx > h.idx" if j else ""
        out += f""",
hit{s}_{j} AS (SELECT min(nn.idx) AS idx FROM nn{s} nn, tot{s} tot{before}
  WHERE CAST(nn.cum AS DOUBLE) <= tot.t * {p} AND tot.t * {p} <= CAST(nn.nxt AS DOUBLE) {past})"""
        labels.append(f"SELECT 'N{round(p * 100):02d}' AS label, nn.len AS value FROM nn{s} nn JOIN hit{s}_{j} USING (idx)")
    return out + f""",
nx{s} AS ({" UNION ALL ".join(labels)})
"""


def _nx_standard(src: str) -> str:
    parts = []
    for p in (0.1, 0.25, 0.5, 0.75, 0.9):
        parts.append(f"SELECT 'N{round(p * 100):02d}' AS label, max(len) AS value FROM hr "
                     f"WHERE CAST(rc AS DOUBLE) >= CAST(t AS DOUBLE) * {p} HAVING max(len) IS NOT NULL")
    return f""", hl AS (SELECT sequence_length_template AS len, count(*) AS c FROM {src} GROUP BY 1),
hr AS (SELECT len, sum(len * c) OVER (ORDER BY len DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rc,
              sum(len * c) OVER () AS t FROM hl)
{" UNION ALL ".join(parts)}
"""


def _report() -> str:
    def stage(name: str, src: str, s: str) -> str:
        d_len = _describe("sequence_length_template", src).strip()
        d_q = _describe("mean_qscore_template", src).strip()
        # trimmed0 still counts time from the run's first read
        last = f"(SELECT max(start_time_float_by_sample) FROM {src})"
        return f"""
SELECT '{name}' AS stage, 'total' AS section, 'bases' AS label, CAST(sum(sequence_length_template) AS DOUBLE) AS value,
       {_human('sum(sequence_length_template)')} AS human FROM {src}
UNION ALL SELECT '{name}', 'sample', 'id', NULL, min(sample_id) FROM {src}
UNION ALL SELECT '{name}', 'length', stat, value, NULL FROM ({d_len})
UNION ALL SELECT '{name}', 'quality', stat, value, NULL FROM ({d_q})
UNION ALL SELECT '{name}', 'nx', label, CAST(value AS DOUBLE), {_human('value')} FROM nx{s}
UNION ALL SELECT '{name}', 'duration', 'seconds', round({last}, 1),
       printf('%d hours, %d minutes, %.0f seconds', CAST(floor({last} / 3600) AS BIGINT),
              CAST(floor(fmod({last}, 3600) / 60) AS BIGINT), fmod(fmod({last}, 3600), 60))"""

    return (BASE + _nx_compat("reads", "_u") + _nx_compat("trimmed0", "_f")
            + "SELECT stage, section, label, round(value, 6) AS value, human FROM ("
            + stage("unfiltered", "reads", "_u") + "\nUNION ALL" + stage("filtered", "trimmed0", "_f") + ")")


def _pair_sample_cte(k: int = 10000) -> str:
    return f""", ps AS (
  SELECT read_id, mean_qscore_template, pore_speed, sequence_length_template, events_ratio, qualitative_pass
  FROM trimmed WHERE events_ratio < 5
  ORDER BY md5('seqyield' || read_id), read_id LIMIT {k})
"""


_SAMPLE_OUT = """
SELECT read_id, round(mean_qscore_template, 6) AS mean_qscore_template, round(pore_speed, 6) AS pore_speed,
       sequence_length_template, round(events_ratio, 6) AS events_ratio, qualitative_pass FROM ps"""


def _pair_hist() -> str:
    union = " UNION ALL ".join(
        f"SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS value, CAST(sequence_length_template AS DOUBLE) AS wt FROM ps"
        for c in ("mean_qscore_template", "pore_speed", "sequence_length_template", "events_ratio"))
    return (BASE + _pair_sample_cte() + f", pv AS ({union})\n"
            + _hist("pv", "value", "10", weight="wt", by="variable")
            + "SELECT variable, bin, round(left_e, 6) AS \"left\", round(right_e, 6) AS \"right\", round(w, 6) AS bases FROM h")


def _zfill(x: str) -> str:
    return (f"(CASE WHEN length(CAST({x} AS VARCHAR)) >= 5 THEN CAST({x} AS VARCHAR) "
            f"ELSE lpad(CAST({x} AS VARCHAR), 5, '0') END)")


MANIFEST = """
WITH s AS (SELECT 'run/sequencing_summary_' || p_partkey || '.txt' AS sequencing_summary_file, p_partkey AS number FROM part),
f AS (SELECT 'run/fastq_' || p_partkey || '.fastq' AS fastq_file, p_partkey AS number FROM part WHERE p_size <= 40),
d AS (SELECT DISTINCT 'run/reads/' || l_partkey AS fast5_dir, l_partkey AS number FROM lineitem),
manifest AS (
  SELECT s.number, sequencing_summary_file, fastq_file, fast5_dir, 'FAB00000' AS "FlowcellID",
         CAST(4242 AS INTEGER) AS rnumber, 'run/reads/checksum.fast5.md5' AS md5_fast5,
         'run/fastq/checksum.fastq.md5' AS md5_fastq
  FROM s JOIN f USING (number) JOIN d USING (number))
"""

# The run files: 500 reads each; every third file has malformed headers, another third short quality lines.
FASTQ_EXPECTED = """
WITH f0 AS (
  SELECT CAST(event_id AS VARCHAR) AS read_id, event_type AS run_id, 'S1' AS sample_id, event_id AS read,
         CAST(user_id % 3000 + 1 AS INTEGER) AS channel, epoch_us(ts) AS start_time_us, ts, event_id // 500 AS number,
         event_id % 500 AS ordinal, (event_id % 50) + 1 AS seq_len,
         event_id // 500 % 3 = 1 AND event_id % 77 = 0 AS bare,
         event_id // 500 % 3 = 1 AND event_type = 'error' AND event_id % 7 = 0 AS flagged,
         event_id // 500 % 3 = 2 AND event_id % 101 = 0 AS short
  FROM events),
fq AS (SELECT *, bare OR flagged AS bad, seq_len - CAST(short AS INTEGER) AS qual_len FROM f0)
"""

# What archives damaged by their number modulo 5 still give: 2 and 4 lose their second half.
DAMAGED = FASTQ_EXPECTED + """
, given AS (
  SELECT *, number % 5 AS kind FROM fq
  QUALIFY number % 5 NOT IN (2, 4) OR ordinal < count(*) OVER (PARTITION BY number) // 2)
"""

# Summary rows as the files hold them: every 333rd template duration is unreadable.
SUMMARY_EXPECTED = """
, sm AS (
  SELECT read_id, run_id, channel, round(start_time_float, 6) AS start_time_float, num_events,
         CASE WHEN read % 333 = 0 THEN NULL ELSE round(template_duration, 6) END AS template_duration,
         sequence_length_template, round(mean_qscore_template, 6) AS mean_qscore_template, read // 500 AS number FROM ev)
"""
_SUMMARY_COLUMNS = ("read_id, run_id, channel, start_time_float, num_events, template_duration, "
                    "sequence_length_template, mean_qscore_template")

# The plan of archiving the run folder: all batches but the last, three targets each.
_RUN_PLAN = """
WITH b AS (SELECT DISTINCT event_id // 500 AS number FROM events),
half AS (SELECT max(number) // 2 AS last FROM b),
pl AS (
  SELECT number, unnest(['fast5', 'fastq', 'summary']) AS kind,
         unnest([CAST(number AS VARCHAR), 'fastq_' || number || '.fastq', 'sequencing_summary_' || number || '.txt']) AS source,
         unnest([z || '.fast5.tar.gz', 'fastq/' || z || '.fastq.gz', 'sequencing_summary/' || z || '.sequencing_summary.txt']) AS target
  FROM (SELECT number, lpad(CAST(number AS VARCHAR), 5, '0') || '_FAB00000_4242' AS z FROM b))
"""

_MEMBERS = """
WITH mb AS (
  SELECT event_id // 500 AS number, event_id % 5 AS m,
         string_agg(event_id || '|' || event_type || '|' || (user_id % 3000 + 1), chr(10) ORDER BY event_id) || chr(10) AS content
  FROM events GROUP BY 1, 2)
"""


# MD5 of every FASTQ and FAST5 file of the run folder, from its whole content.
_FILE_SUMS = _MEMBERS + """,
""" + FASTQ_EXPECTED.replace("WITH", "", 1) + """,
ft AS (
  SELECT number, string_agg('@' || read_id || ' ' || CASE WHEN bare THEN 'flag' ELSE
           printf('runid=%s sampleid=%s read=%d ch=%d start_time=%s', run_id, sample_id, read, channel,
                  strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')) || CASE WHEN flagged THEN ' flag' ELSE '' END END || chr(10)
         || substr(repeat('ACGT', 13), 1, seq_len) || chr(10) || '+' || chr(10) || substr(repeat('@I!#', 13), 1, qual_len) || chr(10),
         '' ORDER BY ordinal) AS content
  FROM fq GROUP BY number),
sums AS (
  SELECT 'fast5' AS kind, number, 'PC_4242_FAH_' || m || '_ch_' || m || '_strand.fast5' AS file, md5(content) AS md5 FROM mb
  UNION ALL SELECT 'fastq', number, 'fastq_' || number || '.fastq', md5(content) FROM ft)
"""


DOCS = """
WITH docs AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS read_id, d.n_chars AS sequence_length_template,
         coalesce(l.quality = 1, false) AS pass, d.lang AS sample_id
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


def _pair_grid() -> str:
    """2-D densities of all variable pairs on the pair sample (table ``kd``): the exact sums over all reads.

    Reads are dealt over chunks; a chunk holds, for every grid line, the kernel values of its reads
    as one list, and a grid point sums the chunks' dot products.
    """
    cols = ("mean_qscore_template", "pore_speed", "sequence_length_template", "events_ratio")
    pairs = [(cols[b], cols[a]) for a in range(len(cols)) for b in range(a)]
    rows = " UNION ALL ".join(
        f"SELECT '{x}' AS x_var, '{y}' AS y_var, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y, read_id FROM ps "
        f"WHERE {x} IS NOT NULL AND {y} IS NOT NULL AND NOT isnan(CAST({x} AS DOUBLE)) AND NOT isnan(CAST({y} AS DOUBLE))" for x, y in pairs)
    return BASE + _pair_sample_cte() + f""", pd AS ({rows}),
pt AS (
  SELECT x_var, y_var, count(*) AS n, stddev_samp(x) AS sx, stddev_samp(y) AS sy, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1,
         quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS ix, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iy
  FROM pd GROUP BY x_var, y_var),
pw AS (
  SELECT *, 1.059 * (CASE WHEN ix > 0 THEN least(sx, ix / 1.349) ELSE sx END) * pow(CAST(n AS DOUBLE), -0.2) AS bwx,
            1.059 * (CASE WHEN iy > 0 THEN least(sy, iy / 1.349) ELSE sy END) * pow(CAST(n AS DOUBLE), -0.2) AS bwy
  FROM pt),
pg AS (
  SELECT x_var, y_var, n, bwx, bwy, k, (x0 - 3 * bwx) + k * (((x1 + 3 * bwx) - (x0 - 3 * bwx)) / 99) AS gx,
         (y0 - 3 * bwy) + k * (((y1 + 3 * bwy) - (y0 - 3 * bwy)) / 99) AS gy
  FROM pw CROSS JOIN range(100) r(k)),
pc AS (
  SELECT x_var, y_var, c, list(x) AS xs, list(y) AS ys
  FROM (SELECT *, row_number() OVER (PARTITION BY x_var, y_var ORDER BY read_id) // 100 AS c FROM pd) GROUP BY x_var, y_var, c),
pe AS (
  SELECT x_var, y_var, c, k, list_transform(xs, lambda v: exp(-0.5 * ((gx - v) / bwx) * ((gx - v) / bwx))) AS ex,
         list_transform(ys, lambda v: exp(-0.5 * ((gy - v) / bwy) * ((gy - v) / bwy))) AS ey
  FROM pc JOIN pg USING (x_var, y_var)),
px AS (
  SELECT a.x_var, a.y_var, a.k AS i, b.k AS j, sum(list_dot_product(a.ex, b.ey)) AS s
  FROM pe AS a JOIN pe AS b ON a.x_var = b.x_var AND a.y_var = b.y_var AND a.c = b.c GROUP BY ALL),
kd AS (
  SELECT px.x_var, px.y_var, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, g.gx AS x, h.gy AS y,
         s / (g.n * g.bwx * g.bwy * 2 * pi()) AS density
  FROM px JOIN pg AS g ON g.x_var = px.x_var AND g.y_var = px.y_var AND g.k = i
  JOIN pg AS h ON h.x_var = px.x_var AND h.y_var = px.y_var AND h.k = j)
"""


_KDE_OUT = "SELECT x_var, y_var, i, j, round(x, 6) AS x, round(y, 6) AS y, round(density, 12) AS density FROM kd"

_LEVELS = """,
ku AS (
  SELECT x_var, y_var, density, sum(density) OVER (PARTITION BY x_var, y_var ORDER BY density DESC, i, j ROWS UNBOUNDED PRECEDING) AS upto,
         sum(density) OVER (PARTITION BY x_var, y_var) AS whole FROM kd),
lv AS (
  SELECT x_var, y_var, CAST(k AS INTEGER) AS level, (9 - k) / 10 AS mass, max(density) AS density
  FROM ku CROSS JOIN range(9) t(k) WHERE upto >= (9 - k) / 10 * whole GROUP BY x_var, y_var, k)
"""

# The sixteen cases of marching squares by which corners (a b c d, from the lower left, anticlockwise) are inside.
_CONTOURS = """,
ce AS (
  SELECT a.x_var, a.y_var, level, a.i, a.j, a.x AS xa, a.y AS ya, c.x AS xb, c.y AS yb,
         a.density AS a, b.density AS b, c.density AS c, d.density AS d, lv.density AS z
  FROM kd AS a
  JOIN kd AS b ON b.x_var = a.x_var AND b.y_var = a.y_var AND b.i = a.i + 1 AND b.j = a.j
  JOIN kd AS c ON c.x_var = a.x_var AND c.y_var = a.y_var AND c.i = a.i + 1 AND c.j = a.j + 1
  JOIN kd AS d ON d.x_var = a.x_var AND d.y_var = a.y_var AND d.i = a.i AND d.j = a.j + 1
  JOIN lv ON lv.x_var = a.x_var AND lv.y_var = a.y_var),
cc AS (
  SELECT *, (a >= z)::INT + 2 * (b >= z)::INT + 4 * (c >= z)::INT + 8 * (d >= z)::INT AS corners, (a + b + c + d) / 4 >= z AS mid,
         xa + (z - a) / (b - a) * (xb - xa) AS bottom, ya + (z - b) / (c - b) * (yb - ya) AS "right",
         xa + (z - d) / (c - d) * (xb - xa) AS top, ya + (z - a) / (d - a) * (yb - ya) AS "left"
  FROM ce),
cp AS (
  SELECT *, unnest(CASE
    WHEN corners IN (1, 14) THEN ['BL'] WHEN corners IN (2, 13) THEN ['BR'] WHEN corners IN (4, 11) THEN ['RT']
    WHEN corners IN (8, 7) THEN ['TL'] WHEN corners IN (3, 12) THEN ['RL'] WHEN corners IN (6, 9) THEN ['BT']
    WHEN corners IN (5, 10) THEN CASE WHEN (corners = 5) = mid THEN ['BR', 'TL'] ELSE ['BL', 'RT'] END
    ELSE [] END) AS sides,
    unnest(CASE WHEN corners IN (0, 15) THEN [] WHEN corners IN (5, 10) THEN [0, 1] ELSE [0] END) AS part
  FROM cc)
SELECT x_var, y_var, level, i, j, CAST(part AS INTEGER) AS part,
       round(CASE sides[1] WHEN 'B' THEN bottom WHEN 'R' THEN xb WHEN 'T' THEN top ELSE xa END, 6) AS x0,
       round(CASE sides[1] WHEN 'B' THEN ya WHEN 'R' THEN "right" WHEN 'T' THEN yb ELSE "left" END, 6) AS y0,
       round(CASE sides[2] WHEN 'B' THEN bottom WHEN 'R' THEN xb WHEN 'T' THEN top ELSE xa END, 6) AS x1,
       round(CASE sides[2] WHEN 'B' THEN ya WHEN 'R' THEN "right" WHEN 'T' THEN yb ELSE "left" END, 6) AS y1
FROM cp"""


_SKETCHED = """
, sk AS (
  SELECT 'sequence_length_template' AS "column", CAST(sequence_length_template AS DOUBLE) AS v FROM ev
  UNION ALL SELECT 'start_time_float', start_time_float FROM ev
  UNION ALL SELECT 'mean_qscore_template', mean_qscore_template FROM ev)
"""

_PEARSON = """
, pr AS (
  SELECT 'pore_speed' AS x, 'mean_qscore_template' AS y, count(*) AS n, corr(pore_speed, mean_qscore_template) AS r
  FROM trimmed WHERE pore_speed IS NOT NULL AND mean_qscore_template IS NOT NULL
  UNION ALL
  SELECT 'sequence_length_template', 'mean_qscore_template', count(*), corr(CAST(sequence_length_template AS DOUBLE), mean_qscore_template)
  FROM t98 WHERE mean_qscore_template IS NOT NULL)"""


def _pearson_test() -> str:
    """p-value by Simpson's rule over the t density, from 0 to |t| in 20,000 steps."""
    return BASE + _qtrim("trimmed", 0.98, "t98") + _PEARSON + """,
pt AS (SELECT *, n - 2.0 AS df, abs(r) * sqrt((n - 2.0) / (1 - r * r)) AS t FROM pr),
pc AS (SELECT *, exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) AS c, t / 20000 AS h FROM pt),
pi AS (
  SELECT x, y, n, r, sum((CASE WHEN k IN (0, 20000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)
                         * c * pow(1 + (k * h) * (k * h) / df, -(df + 1) / 2)) * any_value(h) / 3 AS inner_half
  FROM pc CROSS JOIN range(20001) g(k) GROUP BY x, y, n, r)
SELECT x, y, n, round(r, 9) AS r, round(1 - 2 * inner_half, 9) AS p_value FROM pi"""


ORACLE_SQL: dict[str, str] = {
    "merge_reads": READS + """
SELECT read_id, run_id, channel, sample_id, read, num_events, sequence_length_template,
       round(mean_qscore_template, 6) AS mean_qscore_template, round(template_duration, 6) AS template_duration
FROM merged""",
    "unmatched_reads": READS + """
SELECT 'summary_only' AS side, s.read_id, s.run_id, s.channel FROM ev s
WHERE NOT EXISTS (SELECT 1 FROM fq f WHERE f.read_id = s.read_id AND f.run_id = s.run_id AND f.channel = s.channel)
UNION ALL
SELECT 'fastq_only', f.read_id, f.run_id, f.channel FROM fq f
WHERE NOT EXISTS (SELECT 1 FROM ev s WHERE f.read_id = s.read_id AND f.run_id = s.run_id AND f.channel = s.channel)""",
    "dedup_reads": READS + """
SELECT run_id, channel, read_id FROM (
  SELECT run_id, channel, read_id,
         row_number() OVER (PARTITION BY run_id, channel ORDER BY start_time_float_by_sample, read_id) AS rn
  FROM reads) WHERE rn = 1""",
    "elapsed_time": READS + """
SELECT read_id, round(start_time_float_by_sample, 6) AS start_time_float_by_sample FROM reads""",
    "enrich_reads": READS + """
SELECT read_id, pass, qualitative_pass, round(pore_speed, 6) AS pore_speed, round(events_ratio, 6) AS events_ratio FROM reads""",
    "quantiles": READS + """
SELECT round(quantile_cont(CAST(sequence_length_template AS DOUBLE), 0.98), 6) AS q_length_098,
       round(quantile_cont(CAST(sequence_length_template AS DOUBLE), 0.99), 6) AS q_length_099,
       round(quantile_cont(CAST(sequence_length_template AS DOUBLE), 0.999), 6) AS q_length_0999,
       round(quantile_cont(start_time_float_by_sample, 0.001), 6) AS q_time_0001,
       round(quantile_cont(start_time_float_by_sample, 0.999), 6) AS q_time_0999
FROM reads""",
    "trim_reads": BASE + """
SELECT read_id, sequence_length_template, round(start_time_float_by_sample, 6) AS start_time_float_by_sample FROM trimmed""",
    "quantile_trim_99": BASE + _qtrim("trimmed", 0.99, "t99") + "SELECT read_id, sequence_length_template FROM t99",
    "quantile_trim_98": BASE + _qtrim("trimmed", 0.98, "t98") + "SELECT read_id, sequence_length_template FROM t98",
    "trim_counts": BASE + """
SELECT 'before' AS stage, count(*) AS reads FROM reads UNION ALL SELECT 'after', count(*) FROM trimmed0""",
    "trim_exclusions": BASE + """
SELECT NOT coalesce(r.start_time_float_by_sample > bnd.tmin AND r.start_time_float_by_sample < bnd.tmax, false) AS time_excluded,
       NOT coalesce(r.events_ratio < 20, false) AS ratio_excluded,
       NOT coalesce(r.sequence_length_template < bnd.lmax, false) AS length_excluded,
       count(*) AS reads
FROM reads r, bnd GROUP BY 1, 2, 3""",
    "trim_exclusions_compat": BASE + """
, f AS (
  SELECT coalesce(r.start_time_float_by_sample > bnd.tmin AND r.start_time_float_by_sample < bnd.tmax, false) AS t0,
         coalesce(r.start_time_float_by_sample < bnd.tmin AND r.start_time_float_by_sample > bnd.tmax, false) AS t1,
         coalesce(r.events_ratio < 20, false) AS e,
         coalesce(r.sequence_length_template < bnd.lmax, false) AS l0,
         coalesce(r.sequence_length_template > bnd.lmax, false) AS l1
  FROM reads r, bnd)
SELECT '100' AS region, count(*) FILTER (WHERE t0 AND e AND l1) AS reads FROM f
UNION ALL SELECT '010', count(*) FILTER (WHERE t1 AND e AND l1) FROM f
UNION ALL SELECT '110', count(*) FILTER (WHERE t1 AND e AND l0) FROM f
UNION ALL SELECT '001', count(*) FILTER (WHERE t1 AND e AND l0) FROM f
UNION ALL SELECT '101', count(*) FILTER (WHERE t0 AND e AND l0) FROM f
UNION ALL SELECT '011', count(*) FILTER (WHERE t1 AND e AND l0) FROM f
UNION ALL SELECT '111', count(*) FILTER (WHERE t0 AND e AND l0) FROM f""",
    "running_count": BASE + """
SELECT read_id, row_number() OVER (ORDER BY start_time_float_by_sample, read_id) AS read_count FROM trimmed""",
    "running_yield": BASE + """
SELECT read_id, CAST(sum(sequence_length_template) OVER (ORDER BY start_time_float_by_sample, read_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS yield FROM trimmed""",
    "running_yield_by_channel": BASE + """
SELECT read_id, channel, CAST(sum(sequence_length_template) OVER (PARTITION BY channel ORDER BY start_time_float_by_sample, read_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS channel_yield FROM trimmed""",
    "running_yield_by_pass": BASE + """
SELECT read_id, pass, CAST(sum(sequence_length_template) OVER (PARTITION BY pass ORDER BY start_time_float_by_sample, read_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS quality_yield FROM trimmed""",
    "running_count_by_pass": BASE + """
SELECT read_id, pass, row_number() OVER (PARTITION BY pass ORDER BY start_time_float_by_sample, read_id) AS quality_count FROM trimmed""",
    "yield_curve": _curve("sum(sequence_length_template)", "yield", False),
    "yield_curve_by_quality": _curve("sum(sequence_length_template)", "yield", True),
    "reads_curve": _curve("count(*)", "read_count", False),
    "reads_curve_by_quality": _curve("count(*)", "read_count", True),
    "channel_yield": BASE + """
SELECT channel, CAST(sum(sequence_length_template) AS BIGINT) AS channel_yield FROM trimmed GROUP BY channel""",
    "flowcell_grid": BASE + """
, g AS (SELECT CAST(c AS INTEGER) AS channel FROM range(1, 3001) t(c)),
cy AS (SELECT channel, CAST(sum(sequence_length_template) AS BIGINT) AS y FROM trimmed GROUP BY channel)
SELECT CAST(((channel - 1) % 250) // 10 AS INTEGER) AS row,
       CAST(((channel - 1) // 250) * 10 + (channel - 1) % 10 AS INTEGER) AS col,
       g.channel, coalesce(cy.y, 0) AS bases
FROM g LEFT JOIN cy USING (channel)""",
    "grid_limits": BASE + """
, g AS (SELECT CAST(c AS INTEGER) AS channel FROM range(1, 3001) t(c)),
cy AS (SELECT channel, sum(sequence_length_template) AS y FROM trimmed GROUP BY channel),
cells AS (SELECT CAST(coalesce(cy.y, 0) AS DOUBLE) AS bases FROM g LEFT JOIN cy USING (channel))
SELECT 'vmin' AS "limit", round(quantile_cont(bases, 0.02), 6) AS bases FROM cells
UNION ALL SELECT 'vmax', round(quantile_cont(bases, 0.98), 6) FROM cells""",
    "total_yield": READS + "SELECT CAST(sum(sequence_length_template) AS BIGINT) AS total_bases FROM reads",
    "describe_length": READS + _describe("sequence_length_template"),
    "describe_quality": READS + _describe("mean_qscore_template"),
    "run_duration": BASE + """
, d AS (SELECT max(start_time_float_by_sample) AS duration_s FROM trimmed)
SELECT round(duration_s, 6) AS duration_s, round(floor(duration_s / 3600), 6) AS hours,
       round(floor(fmod(duration_s, 3600) / 60), 6) AS minutes, round(fmod(fmod(duration_s, 3600), 60), 6) AS seconds FROM d""",
    "nx_compat": READS + _nx_compat("reads") + "SELECT label, value FROM nx",
    "nx_standard": READS + _nx_standard("reads"),
    "run_report": _report(),
    "pearson": BASE + _qtrim("trimmed", 0.98, "t98") + _PEARSON + " SELECT x, y, n, round(r, 9) AS r FROM pr",
    "pearson_test": _pearson_test(),
    "weighted_histogram": BASE + _hist("trimmed", "sequence_length_template", "49",
                                       weight="sequence_length_template", lower="0.0") + """
SELECT bin, round(left_e, 6) AS "left", round(right_e, 6) AS "right", round(w, 6) AS bases, round(density, 12) AS density FROM h""",
    "length_histogram": BASE + _qtrim("trimmed", 0.99, "t99") + _hist("t99", "sequence_length_template", None) + """
SELECT bin, round(left_e, 6) AS "left", round(right_e, 6) AS "right", CAST(w AS BIGINT) AS reads, round(density, 12) AS density FROM h""",
    "quality_histogram": BASE + _hist("trimmed", "mean_qscore_template", None) + """
SELECT bin, round(left_e, 6) AS "left", round(right_e, 6) AS "right", CAST(w AS BIGINT) AS reads, round(density, 12) AS density FROM h""",
    "length_kde": BASE + _qtrim("trimmed", 0.99, "t99") + _kde("t99", "sequence_length_template") + """
SELECT CAST(point AS INTEGER) AS point, round(gx, 6) AS x, round(density, 12) AS density FROM k""",
    "quality_kde": BASE + _kde("trimmed", "mean_qscore_template") + """
SELECT CAST(point AS INTEGER) AS point, round(gx, 6) AS x, round(density, 12) AS density FROM k""",
    "quality_ridges": _ridges(),
    "events_ratio_trend": _trend("trimmed", "events_ratio"),
    "pore_speed_trend": _trend("trimmed", "pore_speed"),
    "events_ratio_band": _band("trimmed", "events_ratio"),
    "pore_speed_band": _band("trimmed", "pore_speed"),
    "speed_quality_hexbin": BASE + _hexbin("trimmed", "pore_speed", "mean_qscore_template"),
    "length_quality_hexbin": BASE + _qtrim("trimmed", 0.98, "t98") + _hexbin("t98", "sequence_length_template",
                                                                              "mean_qscore_template"),
    "pair_sample": BASE + _pair_sample_cte() + _SAMPLE_OUT,
    "pair_sample_500": BASE + _pair_sample_cte(500) + _SAMPLE_OUT,
    "pair_view": BASE + _pair_sample_cte() + """
SELECT round(mean_qscore_template, 6) AS "Mean QScore Template", round(pore_speed, 6) AS "Pore Speed (b/s)",
       sequence_length_template AS "Read Length", round(events_ratio, 6) AS "Events / base", qualitative_pass FROM ps""",
    "pair_histogram": _pair_hist(),
    "pair_kde_2d": _pair_grid() + _KDE_OUT,
    "pair_contour_levels": _pair_grid() + _LEVELS + "SELECT x_var, y_var, level, mass, round(density, 12) AS density FROM lv",
    "pair_contour_lines": _pair_grid() + _LEVELS + _CONTOURS,
    "pair_shaded_cells": _pair_grid() + _LEVELS + """
SELECT x_var, y_var, i, j, max(level) AS shade FROM kd JOIN lv USING (x_var, y_var) WHERE kd.density >= lv.density
GROUP BY x_var, y_var, i, j""",
    "documents_nx": DOCS + _nx_compat("docs") + _nx_standard("docs")
                    + " UNION ALL SELECT 'compat_' || label AS label, value FROM nx",
    "documents_weighted_histogram": DOCS + _hist("docs", "sequence_length_template", "49",
                                                 weight="sequence_length_template", lower="0.0") + """
SELECT bin, round(left_e, 6) AS "left", round(right_e, 6) AS "right", round(w, 6) AS bases, round(density, 12) AS density FROM h""",
    "documents_yield_by_quality": DOCS + """
SELECT sample_id AS lang, pass, CAST(sum(sequence_length_template) AS BIGINT) AS bases, count(*) AS reads FROM docs GROUP BY 1, 2""",
    "lineitem_running_quantity": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS qty, epoch_us(l_shipdate) AS ship_us,
       CAST(sum(CAST(l_quantity AS BIGINT)) OVER (ORDER BY epoch_us(l_shipdate), l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CAST(l_quantity AS BIGINT) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running_qty
FROM lineitem""",
    "lineitem_running_price": """
SELECT l_returnflag, l_orderkey, l_linenumber, round(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) OVER (
           PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE, 2) AS running_price
FROM lineitem""",
    "fastq_damaged_records": DAMAGED + """
SELECT number, read_id, CAST(seq_len AS BIGINT) AS seq_len, CAST(qual_len AS BIGINT) AS qual_len, NOT short AS framing_ok
FROM given""",
    "fastq_damaged_report": DAMAGED + """
SELECT number, count(*) AS records, count(*) FILTER (WHERE short) AS bad_framing,
       ANY_VALUE(CASE kind WHEN 2 THEN 'member 0: cut off' WHEN 3 THEN 'member 0: wrong check sum'
                           WHEN 4 THEN 'member 1: not gzip' END) AS error
FROM given GROUP BY number""",
    "fastq_damaged_kept": DAMAGED + """
SELECT number, read_id, CAST(seq_len AS BIGINT) AS seq_len, CAST(qual_len AS BIGINT) AS qual_len, true AS framing_ok
FROM given g WHERE kind < 2 AND NOT EXISTS (SELECT 1 FROM fq b WHERE b.short AND b.number = g.number)""",
    "fastq_source_records": FASTQ_EXPECTED + """
SELECT number, ordinal, read_id, CAST(seq_len AS BIGINT) AS seq_len, CAST(qual_len AS BIGINT) AS qual_len,
       NOT short AS framing_ok FROM fq""",
    "fastq_source_stream": FASTQ_EXPECTED + """
SELECT read_id, run_id, sample_id, read, channel, start_time_us FROM fq WHERE NOT bad AND NOT short""",
    "fastq_headers": FASTQ_EXPECTED + """
SELECT read_id, run_id, sample_id, read, channel, start_time_us FROM fq WHERE NOT bad AND NOT short""",
    "fastq_file_quarantine": FASTQ_EXPECTED + """
SELECT read_id, run_id FROM fq f
WHERE NOT EXISTS (SELECT 1 FROM fq b WHERE (b.bad OR b.short) AND b.number = f.number)""",
    "bad_fastq_headers": FASTQ_EXPECTED + """
SELECT read_id, '@' || read_id || ' ' || CASE WHEN bare THEN 'flag' ELSE
         printf('runid=%s sampleid=%s read=%d ch=%d start_time=%s flag', run_id, sample_id, read, channel,
                strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')) END AS header
FROM fq WHERE bad""",
    "bad_fastq_files": FASTQ_EXPECTED + """
SELECT number, count(*) FILTER (WHERE bad) AS bad_headers, count(*) FILTER (WHERE short) AS bad_framing, count(*) AS records
FROM fq GROUP BY number HAVING count(*) FILTER (WHERE bad OR short) > 0
UNION ALL SELECT 999999, 0, 0, 0""",
    "fastq_records": FASTQ_EXPECTED + """
SELECT number, ordinal, read_id, CAST(seq_len AS BIGINT) AS seq_len, CAST(qual_len AS BIGINT) AS qual_len,
       NOT short AS framing_ok FROM fq""",
    "summary_scan": READS + SUMMARY_EXPECTED + f"SELECT {_SUMMARY_COLUMNS} FROM sm",
    "summary_scan_reordered": READS + SUMMARY_EXPECTED + f"SELECT {_SUMMARY_COLUMNS} FROM sm",
    "summary_broken_cells": """
SELECT event_id // 500 AS number, count(*) AS rows, count(*) FILTER (WHERE event_id % 333 = 0) AS broken_rows,
       count(*) FILTER (WHERE event_id % 333 = 0) AS broken_cells FROM events GROUP BY 1""",
    "summary_intervals": READS + """
SELECT read_id, round(start_time_float, 3) AS start_s, round(start_time_float, 3) AS template_s FROM ev""",
    "single_sample": READS + "SELECT min(sample_id) AS sample_id, count(DISTINCT sample_id) AS samples FROM merged",
    "scan_batches": """
SELECT DISTINCT event_id // 500 AS number, 'sequencing_summary_' || (event_id // 500) || '.txt' AS sequencing_summary_file,
       'fastq_' || (event_id // 500) || '.fastq' AS fastq_file, CAST(event_id // 500 AS VARCHAR) AS fast5_dir,
       CAST(4242 AS INTEGER) AS rnumber FROM events""",
    "manifest_round_trip": """
SELECT DISTINCT event_id // 500 AS number, 'FAB00000' AS "FlowcellID", CAST(4242 AS INTEGER) AS rnumber,
       'run/reads/checksum.fast5.md5' AS md5_fast5, 'run/fastq/checksum.fastq.md5' AS md5_fastq, true AS in_order FROM events""",
    "tidy_first_run": _RUN_PLAN + """
SELECT number, kind, source, target, 'write' AS action FROM pl, half WHERE number < last""",
    "tidy_rerun_new_batch": _RUN_PLAN + """
, held AS (
  SELECT event_id // 500 AS number, 'fast5' AS kind, count(DISTINCT event_id % 5) AS rows FROM events GROUP BY 1
  UNION ALL SELECT event_id // 500, 'fastq', count(*) FROM events GROUP BY 1
  UNION ALL SELECT event_id // 500, 'summary', count(*) FROM events GROUP BY 1)
SELECT pl.number, pl.kind, CASE WHEN pl.number < half.last THEN 'skip' ELSE 'write' END AS action, held.rows
FROM pl JOIN held USING (number, kind), half WHERE pl.number < (SELECT max(number) FROM b)""",
    "compact_batches": _MEMBERS + """
SELECT number, number || '/PC_4242_FAH_' || m || '_ch_' || m || '_strand.fast5' AS member,
       CAST(strlen(content) AS BIGINT) AS length, md5(content) AS md5, true AS content_ok
FROM mb WHERE number < (SELECT max(number) FROM mb)""",
    "fastq_table": FASTQ_EXPECTED + """
SELECT number, ordinal, read_id, NOT short AS framing_ok FROM fq WHERE number < (SELECT max(number) FROM fq)""",
    "relocate_summary": READS + SUMMARY_EXPECTED + """
SELECT number, read_id, sequence_length_template FROM sm WHERE number < (SELECT max(number) FROM sm)""",
    "checksums": _FILE_SUMS + """
SELECT kind, number, md5 || '  ' || file AS line FROM sums WHERE number < (SELECT max(number) FROM sums)""",
    "checksums_streamed": _FILE_SUMS + "SELECT kind, number, md5 || '  ' || file AS line FROM sums",
    "checksums_appended": _FILE_SUMS + "SELECT kind, number, file, md5, CAST(2 AS BIGINT) AS times FROM sums",
    "live_manifest": """
WITH b AS (SELECT event_id // 500 AS number, 2 + count(DISTINCT event_id % 5) AS files FROM events GROUP BY 1)
SELECT number, 'sequencing_summary_' || number || '.txt' AS sequencing_summary_file, 'fastq_' || number || '.fastq' AS fastq_file,
       CAST(number AS VARCHAR) AS fast5_dir, files FROM b WHERE number < (SELECT max(number) FROM b)""",
    "stream_reads": READS + """
SELECT read_id, coalesce(mean_qscore_template > 9, false) AS pass,
       CASE WHEN coalesce(mean_qscore_template > 9, false) THEN 'Passed' ELSE 'Failed' END AS qualitative_pass,
       round(CAST(sequence_length_template AS DOUBLE) / nullif(template_duration, 0), 6) AS pore_speed,
       round(CAST(num_events AS DOUBLE) / nullif(CAST(sequence_length_template AS DOUBLE), 0), 6) AS events_ratio
FROM ev""",
    "stream_merge": READS + """
SELECT read_id, run_id, channel, sample_id, read, sequence_length_template FROM merged WHERE read // 500 % 4 <> 3""",
    "stream_merge_given_up": READS + """
SELECT read_id, run_id, channel FROM merged WHERE read // 500 % 4 = 3""",
    "stream_yield": READS + """
SELECT CAST(floor(epoch_us(start_time_utc) / 600000000) AS BIGINT) * 600000000 AS window_start_us,
       CASE WHEN coalesce(mean_qscore_template > 9, false) THEN 'Passed' ELSE 'Failed' END AS qualitative_pass,
       CAST(sum(sequence_length_template) AS BIGINT) AS bases, count(*) AS reads
FROM ev GROUP BY 1, 2""",
    "stream_channel_totals": READS + """
SELECT channel, CAST(sum(sequence_length_template) AS BIGINT) AS channel_yield, count(*) AS reads FROM ev GROUP BY channel""",
    "stream_running_yield": READS + """
, b AS (SELECT *, read // 500 // (SELECT (max(read) // 500 + 4) // 4 FROM ev) AS batch_id FROM ev)
SELECT coalesce(mean_qscore_template > 9, false) AS pass, batch_id,
       CAST(sum(sum(sequence_length_template)) OVER w AS BIGINT) AS quality_yield,
       CAST(sum(count(*)) OVER w AS BIGINT) AS quality_count
FROM b GROUP BY 1, 2
WINDOW w AS (PARTITION BY coalesce(mean_qscore_template > 9, false) ORDER BY batch_id)""",
    "stream_summary": READS + SUMMARY_EXPECTED + f"SELECT {_SUMMARY_COLUMNS} FROM sm",
    "stream_fastq_headers": FASTQ_EXPECTED + """
SELECT read_id, run_id, sample_id, read, channel, start_time_us FROM fq WHERE NOT bad AND NOT short""",
    "stream_running_reads": READS + """
SELECT read_id, channel, epoch_us(start_time_utc) AS time_us, count(*) OVER w AS channel_count,
       CAST(sum(sequence_length_template) OVER w AS BIGINT) AS channel_yield
FROM ev WINDOW w AS (PARTITION BY channel ORDER BY epoch_us(start_time_utc), read_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "stream_unmatched": READS + """
SELECT read_id, run_id, channel, 'summary' AS side FROM ev WHERE read // 500 % 4 = 3 OR read % 13 = 0
UNION ALL
SELECT CASE WHEN read % 13 = 0 THEN read_id || '-x' ELSE read_id END, run_id, channel, 'fastq'
FROM ev WHERE read // 500 % 4 = 3 OR read % 13 = 0""",
    "stream_dedup": READS + """
SELECT read_id, run_id, channel, sequence_length_template FROM ev""",
    "sketch_describe": READS + _SKETCHED + """
SELECT "column", unnest(['count', 'mean', 'std', 'min', 'max']) AS stat,
       round(unnest([count(v)::DOUBLE, avg(v), stddev_samp(v), min(v), max(v)]), 4) AS value
FROM sk WHERE v IS NOT NULL GROUP BY sk."column" """,
    "sketch_rank_errors": READS + _SKETCHED + """
SELECT "column", unnest([0.001, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999])::DOUBLE AS p, count(v) AS n, true AS within
FROM sk WHERE v IS NOT NULL GROUP BY sk."column" """,
    "batch_manifest": MANIFEST + "SELECT * FROM manifest",
    "drop_active_batch": MANIFEST + "SELECT * FROM manifest WHERE number < (SELECT max(number) FROM manifest)",
    "archive_plan": MANIFEST + f""",
n AS (SELECT *, {_zfill('number')} || '_FAB00000_4242' AS an FROM manifest),
plan AS (
  SELECT number, 'fast5' AS kind, fast5_dir AS source, an || '.fast5.tar.gz' AS target FROM n
  UNION ALL SELECT number, 'fastq', fastq_file, 'fastq/' || an || '.fastq.gz' FROM n
  UNION ALL SELECT number, 'summary', sequencing_summary_file, 'sequencing_summary/' || an || '.sequencing_summary.txt' FROM n),
ex AS (SELECT DISTINCT {_zfill('p_partkey')} || '_FAB00000_4242.fast5.tar.gz' AS t FROM part WHERE p_size > 45)
SELECT number, kind, source, target, CASE WHEN ex.t IS NOT NULL THEN 'skip' ELSE 'write' END AS action
FROM plan LEFT JOIN ex ON plan.target = ex.t""",
}
