"""DuckDB SQL of the registered queries, built from shared common table expressions."""

from __future__ import annotations

from itertools import permutations

K, DEGREE = 12, 5
SUBSET = (7, 2, 9, 2, 4)
WORD = (3, 1, 8)
DIGITS = 9
#: Share of the distance cap within which a word covers a plan, and digits of the fixed point.
ETA, FIXED_DIGITS = 0.3, 8
#: Steps of a chain that a stream leaves out at its start, and samples that it takes.
BURN_IN, CHAIN = 10, 120
#: Plans drawn from a stratum.
DRAWN = 3
#: Share of the cap within which districts are near.
NEAR = 0.2


def ensemble(unit: str = "week", shared_tags: bool = False) -> str:
    tag = "case when o < 2 then 'a' else 'b' end" if shared_tags else "case when o in (0, 2) then 'row' else 'col' end"
    return f"""
g as (select date_trunc('{unit}', o_orderdate) t, c_nationkey p, count(*) n
  from orders join customer on o_custkey = c_custkey group by 1, 2),
s as (select t, row_number() over (order by t) step from (select distinct t from g) q),
cell as (select s.step, s.step % 4 o, k.n_nationkey p, cast(floor(k.n_nationkey / 5) as bigint) x,
  k.n_nationkey % 5 y, coalesce(g.n, 0) + 1 w
  from s cross join nation k left join g on g.t = s.t and g.p = k.n_nationkey),
snake as (select *, case when o in (0, 2) then x * 5 + (case when x % 2 = 0 then y else 4 - y end)
  else y * 5 + (case when y % 2 = 0 then x else 4 - x end) end k0 from cell),
cum as (select step, o, p, w, sum(w) over (partition by step order by k0 rows unbounded preceding) cw,
  sum(w) over (partition by step) tw from snake),
asg as (select step, {tag} sample_tag, p, least(cast(floor((cw - w) * 3 / tw) as int), 2) district_id from cum),
grid3 as (select step, sample_tag, d district_id from (select distinct step, sample_tag from asg) q, (select unnest([0, 1, 2]) d) r),
ds as (select g.step, g.sample_tag, g.district_id, coalesce(string_agg(cast(a.p as varchar), '.' order by a.p), '') district_str
  from grid3 g left join asg a on a.step = g.step and a.district_id = g.district_id group by 1, 2, 3),
cat as (select district_str, row_number() over (order by f) - 1 district_uid
  from (select district_str, min(step * 3 + district_id) f from ds group by 1) z),
pl as (select step, sample_tag, string_agg(cast(district_uid as varchar), '.' order by district_uid) plan_str,
  string_agg(cast(district_uid as varchar), '.' order by district_id) plan from ds join cat using (district_str) group by 1, 2),
cnt as (select sample_tag, plan_str, count(*) cnt from pl group by 1, 2),
dist as (select sample_tag, plan_str, cnt, cnt / sum(cnt) over (partition by sample_tag) freq,
  row_number() over (order by sample_tag, plan_str) - 1 plan_uid from cnt),
pop as (select n_nationkey p, count(c_custkey) w from nation left join customer on c_nationkey = n_nationkey group by 1),
capq as (select cast((2 * sum(w)) // 3 as bigint) cap from pop),
mem as (select district_uid, cast(unnest(string_split(district_str, '.')) as int) p from cat where district_str <> ''),
dw as (select cat.district_uid, cast(coalesce(sum(w), 0) as bigint) w from cat left join mem using (district_uid) left join pop using (p) group by 1)
"""


PAIRS = """
inter as (select a.district_uid i, b.district_uid j, sum(pop.w) x from mem a join mem b on a.p = b.p and a.district_uid > b.district_uid
  join pop on pop.p = a.p group by 1, 2),
dd as (select a.district_uid i, b.district_uid j, a.w + b.w - 2 * coalesce(x, 0) raw, least(a.w + b.w - 2 * coalesce(x, 0), cap) d
  from dw a join dw b on a.district_uid > b.district_uid left join inter on i = a.district_uid and j = b.district_uid cross join capq)
"""


def clusters(epochs: int) -> str:
    """Assignments a0 .. a<epochs>, and densities, centroids and distances of each."""
    out = [f"a0 as (select district_uid, cast(district_uid % {K} as int) c from cat)"]
    for n in range(epochs + 1):
        out.append(f"""
cs{n} as (select c, count(*) sz from a{n} group by 1),
dn{n} as (select c, p, count(*) n from mem join a{n} using (district_uid) group by 1, 2),
cm{n} as (select c, p from dn{n} join cs{n} using (c) where 2 * n >= sz),
cw{n} as (select k.c, cast(coalesce(sum(w), 0) as bigint) w from (select cast(unnest(range({K})) as int) c) k left join cm{n} using (c) left join pop using (p) group by 1),
ci{n} as (select m.district_uid, q.c, sum(pop.w) x from mem m join cm{n} q on q.p = m.p join pop on pop.p = m.p group by 1, 2),
cd{n} as (select d.district_uid, k.c, least(d.w + k.w - 2 * coalesce(x, 0), cap) d from dw d cross join cw{n} k cross join capq
  left join ci{n} i on i.district_uid = d.district_uid and i.c = k.c)""")
        if n < epochs:
            out.append(f"""
a{n + 1} as (select district_uid, c from (select cd.district_uid, cd.c, row_number() over (partition by cd.district_uid
  order by d, case when cd.c = a.c then 0 else 1 end, cd.c) r from cd{n} cd join a{n} a on a.district_uid = cd.district_uid) q where r = 1)""")
    return ",".join(out)


DENSITY = f"""
den as (select k.c, q.p, coalesce(n / sz, 0)::double dens from (select cast(unnest(range({K})) as int) c) k
  cross join (select n_nationkey p from nation) q left join cs1 on cs1.c = k.c left join dn1 on dn1.c = k.c and dn1.p = q.p)
"""

L2 = """
mass as (select c, sum(dens * w) mass from den join pop using (p) group by 1),
sh as (select m.district_uid, den.c, sum(dens * pop.w) x from mem m join den on den.p = m.p join pop on pop.p = m.p group by 1, 2),
l2 as (select d.district_uid, k.c, least(greatest(mass + d.w - 2 * coalesce(x, 0), 0), cap)::double d from dw d cross join mass k cross join capq
  left join sh on sh.district_uid = d.district_uid and sh.c = k.c)
"""


def words(degree: int = DEGREE, dedupe: bool = True, cap: float | None = None, key: str = "plan_str") -> str:
    """Beam stages over three districts, then the rows of words."""
    keep = "" if cap is None else f" and d <= {cap}"
    stages = f"""
ll as (select district_uid, c l, d::double d, row_number() over (partition by district_uid order by d, c) r from cd1),
px as (select plan_uid, plan_str, freq, unnest(string_split(plan_str, '.'))::bigint district_uid, unnest(range(1, 4)) k from dist),
b1 as (select * from (select plan_uid, d, [l] w, row_number() over (partition by plan_uid order by d, [l]) r from px join ll using (district_uid)
  where k = 1 and ll.r <= {degree}{keep}) q where r <= {degree})"""
    for k in (2, 3):
        stages += f""",
b{k} as (select * from (select plan_uid, d, w, row_number() over (partition by plan_uid order by d, w) r from (
  select b.plan_uid, b.d + ll.d as d, list_append(b.w, l) w from b{k - 1} b join px on px.plan_uid = b.plan_uid and px.k = {k}
  join ll on ll.district_uid = px.district_uid and (b.r - 1) + (ll.r - 1) < {degree}) z where true{keep}) q where r <= {degree})"""
    word = "list_sort(b3.w)" if dedupe else "b3.w"
    stages += f""",
wr as (select b3.plan_uid, dist.plan_str, freq, b3.r - 1 place, d distance, min(d) over (partition by b3.plan_uid) min_distance, {word} word,
  array_to_string(list_sort(b3.w), '.') word_str from b3 join dist using (plan_uid)),
wd as (select * from (select *, row_number() over (partition by {key}, word_str order by plan_uid, place) rr from wr) q where rr = 1{"" if dedupe else " or true"}),
wx as (select *, dense_rank() over (order by word_str) - 1 word_uid from wd)"""
    return stages


STRATA = f"""
ph as (select *, exp(-1.0 * (case when distance = 0 and min_distance = 0 then 1.0 when min_distance = 0 then 'inf'::double else distance / min_distance end - 1.0)) phi from wx),
pn as (select *, phi / sum(phi) over (partition by plan_uid) phi_normalized from ph),
pf as (select *, phi_normalized * freq phi_freq from pn),
st as (select word_uid, word_str, sum(phi_freq) stationary from pf group by 1, 2),
fx as (select a.word_uid word1, b.word_uid word2, sum(a.phi_normalized * b.phi_normalized * a.freq) / any_value(st.stationary) value
  from pf a join pf b on a.plan_uid = b.plan_uid join st on st.word_uid = a.word_uid group by 1, 2)
"""

#: Each plan and its chain's next one, with the cheapest of all ways to match their districts.
NEXT = f"""
sym as (select i, j, d from dd union all select j, i, d from dd union all select district_uid, district_uid, 0 from cat),
nx as (select sample_tag, step, lead(step) over (partition by sample_tag order by step) next_step, string_split(plan, '.')::bigint[] a,
  lead(string_split(plan, '.')::bigint[]) over (partition by sample_tag order by step) b from pl),
ways as (select * from (values {", ".join(map(str, permutations((1, 2, 3))))}) v(p1, p2, p3)),
ma as (select sample_tag, step, next_step, min(x.d + y.d + z.d) d from nx cross join ways
  join sym x on x.i = a[1] and x.j = b[p1] join sym y on y.i = a[2] and y.j = b[p2] join sym z on z.i = a[3] and z.j = b[p3] where next_step is not null group by all)
"""

#: A plain greedy cover, a pick at a time.
COVER = f"""
wp as (select word_uid, list(distinct plan_uid) plans from wx cross join capq where distance <= cap * {ETA} group by 1),
picks as (select 0 as n, null::bigint as word_uid, 0::bigint as gain, []::bigint[] as seen
  union all select n + 1, best.u, best.g, list_concat(seen, best.p) from (
    select n, any_value(seen) seen, max(struct_pack(g := len(list_filter(plans, lambda x: not list_contains(seen, x))), o := -wp.word_uid, u := wp.word_uid,
      p := list_filter(plans, lambda x: not list_contains(seen, x)))) best from picks, wp group by n) q where best.g > 0)
"""

#: Costs of the first t + 1 districts as one cluster, for every t, and the knee of their curve.
LADDER = """
pre as (select c.district_uid t, m.district_uid v, m.w from cat c join dw m on m.district_uid <= c.district_uid),
pc as (select t, p, count(*) n from pre join mem on mem.district_uid = v group by all),
ctr as (select t, p from pc where 2 * n >= t + 1),
ctw as (select cat.district_uid t, coalesce(sum(w), 0) cw from cat left join ctr on ctr.t = cat.district_uid left join pop using (p) group by 1),
shr as (select pre.t, v, sum(pop.w) x from pre join mem on mem.district_uid = v join ctr on ctr.t = pre.t and ctr.p = mem.p join pop on pop.p = mem.p group by all),
curve as (select (select count(*) from cat) - t k, cast(sum(least(w + cw - 2 * coalesce(x, 0), cap)) as bigint) wcss from pre join ctw using (t) left join shr using (t, v) cross join capq group by t),
ends as (select min(k) k0, max(k) k1, max_by(wcss, k) w1, min_by(wcss, k) w0 from curve),
below as (select k, wcss, round(w0 + (w1 - w0) * (k - k0) / greatest(k1 - k0, 1) - wcss, 6) below from curve, ends)
"""

#: Members of districts, rarest first, with what stands before each.
INDEX = f"""
lim as (select cast(floor(cap * {NEAR}) as bigint) as bound from capq),
oft as (select p, count(*) often from mem group by 1),
ord as (select district_uid, dw.w, p, coalesce(sum(pop.w) over (partition by district_uid order by often, p rows between unbounded preceding and 1 preceding), 0) before
  from mem join oft using (p) join pop using (p) join dw using (district_uid)),
idx as (select ord.* from ord, lim where before <= bound)
"""

#: The plans of smallest keys in each stratum, and the chance that each was drawn.
DRAWS = f"""
ky as (select word_uid, plan_uid, phi_freq w, -ln((cast('0x' || substr(md5('0:' || word_uid || ':' || plan_uid), 1, 12) as bigint) + 0.5) / 281474976710656.0) / phi_freq as key from pf where phi_freq > 0),
rk as (select *, row_number() over (partition by word_uid order by key, plan_uid) place from ky),
lo as (select word_uid, key out from rk where place = {DRAWN} + 1),
dr as (select word_uid, plan_uid, w, case when out is null then 1.0 else 1 - exp(-w * out) end inclusion from rk left join lo using (word_uid) where place <= {DRAWN})
"""

#: Pairs of nations in the order in which they merge.
PAIRED = "pairs as (select cast(p // 2 as bigint) k, cast(sum(w) as bigint) d from pop where p < 24 group by 1), merged as (select k, d, row_number() over (order by d, k) - 1 step from pairs)"

#: Components of the flux graph, and the weights of each component scaled to 1.
FIXED = """
hop as (select word1 a, word2 b from fx where value > 0 union select word2, word1 from fx where value > 0),
reach as (select a, b from hop union select r.a, hop.b from reach r join hop on hop.a = r.b),
comp as (select a word_uid, min(b) component from reach group by 1)
"""

LETTERS = "wl as (select * from (values " + ", ".join(f"({k}, {x})" for k, x in enumerate(WORD)) + ") v(place, letter))"


def _r(expr: str, name: str) -> str:
    return f"round({expr}, {DIGITS}) as {name}"


def _edges(sample: int, bins: int) -> str:
    """Quantile edges of the distances among districts sampled in the order of a hash."""
    return f""", smp as (select district_uid from cat order by md5('0:' || district_str), district_str limit {sample}),
padded as (select d::double d from dd, capq where d < cap and i in (from smp) and j in (from smp) union all select -1 union all select cap + 1 from capq),
q as (select unnest(quantile_cont(d, [{", ".join(str(k / bins) for k in range(bins + 1))}])) e from padded)
select distinct cast(trunc(e) as int) edge from q"""


def _with(*parts: str, recursive: bool = False) -> str:
    return ("with recursive " if recursive else "with ") + ",".join(parts) + " "


def oracle_sql() -> dict[str, str]:
    base = ensemble()
    one, two = clusters(1), clusters(2)
    word_parts = (base, one, words())
    strata = (*word_parts, STRATA)
    dens = (base, one, DENSITY)
    word_cols = "plan_uid, place, array_to_string(word, '.') word, distance, min_distance, plan_str, word_str, word_uid"
    cell = "(select unnest(range(25)) id) q"
    # Districts numbered as two files in a row hold them.
    filed = base.replace("min(step * 3 + district_id) f", "min(case when sample_tag = 'row' then 0 else 100000000 end + step * 3 + district_id) f")
    label = "'(' || (id // 5) || ',' || (id % 5) || ')'"
    files = "select case when sample_tag = 'row' then 0 else 1 end f, step, sample_tag, string_agg(cast(district_id as varchar), '.' order by p) plan_vector from asg group by 1, 2, 3"
    ltr = "sum(dens * x) / nullif(sum(dens), 0)"
    return {
        "grid_graph_nodes": _with(base) + f"""select cast(id as int) precinct_id, {label} precinct_id_str,
cast((id // 5 = 0)::int + (id // 5 = 4)::int + (id % 5 = 0)::int + (id % 5 = 4)::int as int) border_length,
cast(id // 5 as int) x_location, cast(id % 5 as int) y_location, 1 area, w::bigint population, 'A' county from (select p id, w from pop) q""",
        "grid_graph_edges": """select cast(a.n_nationkey as int) src, cast(b.n_nationkey as int) dst, 1::bigint length from nation a, nation b
where abs(a.n_nationkey // 5 - b.n_nationkey // 5) + abs(a.n_nationkey % 5 - b.n_nationkey % 5) = 1""",
        "grid_shape": _with(base) + f"""select cast(id as int) as cell, w::bigint population, {label} precinct, (id % 5) * 2.0::double x0, (id // 5) * 2.0::double y0,
(id % 5) * 2.0::double + 2 x1, (id // 5) * 2.0::double + 2 y1, 'EPSG:3857' crs from (select p id, w from pop) q""",
        "precinct_weights": _with(base) + "select cast(p as int) precinct, w population from pop",
        "distance_cap": _with(base) + "select cast(sum(w) as bigint) total, any_value(cap) as cap from pop, capq",
        "plan_assignments": _with(base) + "select step, sample_tag, cast(p as int) precinct, district_id from asg",
        "samples_expanded": _with(base) + "select step, sample_tag, step - 1 as plan_id, district_id, district_str from ds",
        "district_catalog": _with(base) + "select district_uid, district_str, w weight from cat join dw using (district_uid)",
        "plans": _with(base) + "select step, step - 1 as plan_id, sample_tag, plan, plan_str from pl",
        "plan_distribution": _with(base) + "select plan_uid, sample_tag, plan_str, cnt, " + _r("freq", "freq") + " from dist",
        "plan_distribution_shared_tags": _with(ensemble("week", True)) + "select plan_uid, sample_tag, plan_str, cnt, " + _r("freq", "freq") + " from dist",
        "plan_distribution_daily": _with(ensemble("day")) + "select plan_uid, sample_tag, plan_str, cnt, " + _r("freq", "freq") + " from dist",
        "decode_plan": _with(base) + "select plan_uid, mem.p precinct, cast(max(k) as int) district_id from (select plan_uid, unnest(string_split(plan_str, '.'))::bigint district_uid, unnest(range(3)) k from dist) q join mem using (district_uid) group by 1, 2",
        "decode_district": _with(base) + "select district_uid, p precinct from mem",
        "encode_district": _with(base) + "select a.step, a.district_id, a.district_str, b.district_uid from ds a join cat b using (district_str)",
        "indicator_vector": _with(base) + "select c.district_uid, string_agg(case when m.p is null then '0' else '1' end, '' order by k.n_nationkey) bits from cat c cross join nation k left join mem m on m.district_uid = c.district_uid and m.p = k.n_nationkey group by 1",
        "district_distance": _with(base, PAIRS) + "select i, j, cast(d as bigint) d from dd",
        "district_distance_dense": _with(base, PAIRS) + "select i, j, raw::double d from dd",
        "distance_edges": _with(base, PAIRS) + """, padded as (select d::double d from dd, capq where d < cap union all select -1 union all select cap + 1 from capq),
q as (select unnest(quantile_cont(d, [""" + ", ".join(str(k / 50) for k in range(51)) + """])) e from padded)
select distinct cast(trunc(e) as int) edge from q""",
        "distance_edges_sampled": _with(base, PAIRS) + _edges(40, 20),
        "ingested_edges": _with(base, PAIRS) + _edges(100, 50),
        "ingested_edges_on_reload": _with(base, PAIRS) + _edges(500, 400),
        "ingested_distances": _with(base, PAIRS) + "select least(x.district_str, y.district_str) one, greatest(x.district_str, y.district_str) two, cast(d as bigint) d from dd join cat x on x.district_uid = i join cat y on y.district_uid = j",
        "ingested_districts": _with(base) + "select district_str, w weight from cat join dw using (district_uid)",
        "ingested_distributions": _with(base) + """, parts as (select plan_uid, sample_tag, cnt, freq, unnest(string_split(plan_str, '.'))::bigint district_uid from dist)
select sample_tag, string_agg(district_str, '|' order by district_str) plan, cnt, """ + _r("freq", "freq") + " from parts join cat using (district_uid) group by plan_uid, sample_tag, cnt, freq",
        "ingested_samples": _with(base) + f", files as ({files})" + " select row_number() over (order by f, step) - 1 as plan_id, step, sample_tag, plan_vector from files",
        "atlas_two_files": _with(base) + f", files as ({files})" + """, kept as (select * from (select *, row_number() over (partition by f order by step) r from files where step > 9) z where r <= 60)
select row_number() over (order by f, step) - 1 as plan_id, step, sample_tag, plan_vector, 3 as districts from kept""",
        "graph_precincts": _with(base) + f"""select cast(id as int) precinct_idx, cast(id as int) precinct_id, {label} precinct_id_str,
cast((id // 5 = 0)::int + (id // 5 = 4)::int + (id % 5 = 0)::int + (id % 5 = 4)::int as int) border_length,
cast(id // 5 as int) x_location, cast(id % 5 as int) y_location, 1 area, w::bigint population, 'A' county from (select p id, w from pop) q""",
        "graph_labels": f"select {label} as label, cast(id as int) precinct_idx from {cell}",
        "graph_edges": """select cast(a.id as int) src, cast(b.id as int) dst, 1::bigint length from (select unnest(range(25)) id) a, (select unnest(range(25)) id) b
where abs(a.id // 5 - b.id // 5) + abs(a.id % 5 - b.id % 5) = 1""",
        "graph_weights": _with(base) + "select string_agg(cast(w as varchar), '.' order by p) weights, cast(sum(w) as bigint) total, any_value(cap) as cap from pop, capq",
        "hcc_paired_linkage": _with(base, PAIRED) + "select cast(step as int) step, 2 * k + 1 as a, 2 * k as b, d as distance, 2::bigint as size from merged",
        "hcc_paired_cut": _with(base, PAIRED) + "select 2 * k + unnest([0, 1]) as district_uid, cast(step as int) cluster_id from merged",
        "hcc_linkage_totals": _with(base, PAIRS) + "select n - 1 as merges, n as last_size, f as first_distance, 2 * n - 2 as children, 0::bigint as falls from (select count(*) n from cat) x, (select cast(min(d) as bigint) f from dd) y",
        "sampled_plan_checks": "select 4 * 20 * 3::bigint as districts, 0::bigint as unbalanced, 0::bigint as split",
        "spectra_traces": _with(*strata) + """, deg as (select word1, count(*) n from fx where value > 0 group by 1),
lp as (select word1, word1 word2, (n - 1)::double as value from deg union all select word1, word2, -1.0 from fx where value > 0 and word1 <> word2),
mats as (select 'flux' kind, word1, word2, value from fx union all select 'laplacian', word1, word2, value from lp)
select a.kind, round((select sum(value) from mats m where m.kind = a.kind and word1 = word2), 5) as trace, round(sum(a.value * b.value), 5) as trace_of_square
from mats a join mats b on a.kind = b.kind and a.word1 = b.word2 and a.word2 = b.word1 group by 1""",
        "cluster_density": _with(*dens) + "select c cluster_id, cast(p as int) precinct, " + _r("dens", "dens") + " from den",
        "cluster_centroids": _with(base, one) + "select k.c cluster_id, coalesce(string_agg(cast(p as varchar), '.' order by p), '') members, any_value(k.w) weight from cw1 k left join cm1 using (c) group by 1",
        "assign_nearest": _with(base, one) + "select district_uid, c cluster_id from a1",
        "kcentroids_2_epochs": _with(base, two) + "select district_uid, c cluster_id from a2",
        "wcss_table": _with(base, two) + "select a.district_uid, a.c letter, cast(d as bigint) dcentroid from a2 a join cd2 using (district_uid, c)",
        "wcss_total": _with(base, two) + "select cast(sum(d) as bigint) wcss from a2 join cd2 using (district_uid, c)",
        "letter_distance_l1": _with(base, one) + "select district_uid, cast(row_number() over (partition by district_uid order by d, c) - 1 as int) place, c letter, d::double distance from cd1",
        "letter_distance_l2": _with(*dens, L2) + "select district_uid, c letter, " + _r("d", "distance") + " from l2",
        "letter_subset": _with(base, one) + "select district_uid, cast(row_number() over (partition by district_uid order by d, list_position([7, 2, 9, 4], c)) - 1 as int) place, c letter, d::double distance from cd1 where c in (7, 2, 9, 4)",
        "plan_words": _with(*word_parts) + f"select {word_cols} from wx",
        "plan_words_nodedupe": _with(base, one, words(dedupe=False)) + f"select {word_cols} from wx",
        "plan_words_heap": _with(base, one, words(dedupe=False)) + "select plan_uid, place, distance, min_distance from wx",
        "plan_words_capped": _with(base, one, words(cap=CAP)) + f"select {word_cols} from wx",
        "plan_words_shared_tags": _with(ensemble("week", True), one, words()) + f"select {word_cols} from wx",
        "pou_weights": _with(*strata) + "select plan_uid, word_uid, " + ", ".join(_r(c, n) for c, n in (("freq", "plan_freq"), ("phi", "phi"), ("phi_normalized", "phi_normalized"), ("phi_freq", "phi_freq"))) + " from pf",
        "stationary": _with(*strata) + "select word_uid, word_str, " + _r("stationary", "stationary") + " from st",
        "stationary_top3": _with(*strata) + "select word_uid, word_str, " + _r("stationary", "stationary") + " from st order by st.stationary desc, word_uid limit 3",
        "word_metadata": _with(*strata) + "select distinct word_uid, word_str, array_to_string(word, '.') word from wx",
        "flux": _with(*strata) + "select word1, word2, " + _r("value", "value") + " from fx where value > 0",
        "flux_labelled": _with(*strata) + "select a.word_str word1_str, b.word_str word2_str, " + _r("value", "value") + " from fx join st a on a.word_uid = word1 join st b on b.word_uid = word2 where value > 0",
        "word_adjacency": _with(*strata) + "select word1, word2 from fx where value > 0",
        "word_laplacian": _with(*strata) + ", deg as (select word1, count(*) n from fx where value > 0 group by 1) select word1, word1 word2, n - 1 as value from deg where n > 1 union all select word1, word2, -1 from fx where value > 0 and word1 <> word2",
        "words_ltr": _with(*dens, LETTERS) + ", xs as (select place, letter, " + f"coalesce({ltr}, 'inf'::double) x from wl join den on c = letter join (select n_nationkey p, n_nationkey % 5 + 0.5::double x from nation) g using (p) group by 1, 2) select place, letter, " + _r("x", "x") + ", cast(row_number() over (order by x, place) - 1 as int) rank from xs",
        "words_ltr_threshold": _with(*dens, LETTERS) + ", xs as (select place, letter, coalesce(avg(x) filter (where dens >= 0.5), 'inf'::double) x from wl join den on c = letter join (select n_nationkey p, n_nationkey % 5 + 0.5::double x from nation) g using (p) group by 1, 2) select place, letter, " + _r("x", "x") + ", cast(row_number() over (order by x, place) - 1 as int) rank from xs",
        "word_blend": _with(*dens, LETTERS) + ", co as (select * from (values (0, 1.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0), (2, 0.0, 0.0, 1.0)) v(place, cr, cg, cb)), m as (select cast(p as int) precinct, dens, case when dens >= 0.5 then dens else 0 end m, cr, cg, cb from wl join den on c = letter join co using (place)) select precinct, "
        + ", ".join(_r(f"sum(m * {c}) / nullif(sum(m), 0)", n) for c, n in (("cr", "r"), ("cg", "g"), ("cb", "b"))) + ", count(*) filter (where dens >= 0.5) letters, count(*) filter (where dens >= 0.5) > 1 as overlap from m group by 1",
        "word_facets": _with(*dens, LETTERS) + ", f as (select place, letter, cast(p as int) precinct, dens from wl join den on c = letter) select place, letter, precinct, " + _r("dens", "value") + ", " + _r("min(dens) over ()", "vmin") + ", " + _r("max(dens) over ()", "vmax") + " from f",
        "letter_alphas": _with(*dens, LETTERS) + ", f as (select place, letter, cast(p as int) precinct, dens, max(dens) over (partition by place) peak from wl join den on c = letter) select place, letter, precinct, " + _r("dens / peak", "alpha") + " from f where peak > 0",
        "plan_frame": _with(base) + "select plan_uid, mem.p precinct, cast(max(k) as int) district_id, (mem.p % 5)::double x0, (mem.p // 5)::double y0 from (select plan_uid, unnest(string_split(plan_str, '.'))::bigint district_uid, unnest(range(3)) k from dist) q join mem using (district_uid) group by 1, 2, 4, 5",
        "district_mask": _with(base) + "select c.district_uid, cast(n_nationkey as int) precinct, m.p is not null as selected from cat c cross join nation left join mem m on m.district_uid = c.district_uid and m.p = n_nationkey",
        "atlas_round_trip": _with(base) + "select step - 1 as plan_id, step, 'atlas' as sample_tag, string_agg(cast(district_id as varchar), '.' order by p) plan_vector from asg group by 1, 2, 3",
        "plan_step_distance": _with(base, PAIRS, NEXT) + "select sample_tag, step, next_step, cast(d as bigint) d from ma",
        "word_cover": _with(*word_parts, COVER, recursive=True) + "select word_uid, cast(n - 1 as bigint) as place, gain from picks where n > 0",
        "plan_cover": _with(*word_parts, COVER, recursive=True) + "select plan_uid, word_uid, cast(place as bigint) place from (select unnest(p) plan_uid, word_uid, place from (select word_uid, n - 1 place, seen[len(seen) - gain + 1:] p from picks where n > 0) a) b",
        "elbow_of_ladder": _with(base, PAIRS, LADDER) + "select k, wcss, k = (select k from below order by below desc, k limit 1) knee from below",
        "near_district_candidates": _with(base, PAIRS, INDEX) + """select (select count(*) from (select x.district_uid, y.district_uid from idx x join idx y on x.p = y.p and x.district_uid > y.district_uid, lim where abs(x.w - y.w) <= bound and x.before + y.before <= bound
  union select x.district_uid, y.district_uid from dw x join dw y on x.district_uid > y.district_uid, lim where x.w + y.w <= bound) q) as candidates,
(select count(*) from dd, lim where raw <= bound) as near, cast(count(*) * (count(*) - 1) / 2 as bigint) as pairs from cat""",
        "near_districts": _with(base, PAIRS) + f"select i, j, cast(raw as bigint) d from dd, capq where raw <= cast(floor(cap * {NEAR}) as bigint)",
        "stratified_plans": _with(*strata, DRAWS) + f"select word_uid, plan_uid, round(w, {FIXED_DIGITS}) w, round(inclusion, {FIXED_DIGITS}) inclusion from dr",
        "stratified_weights": _with(*strata, DRAWS) + f"select word_uid, count(*) drawn, round(sum(w / inclusion), {FIXED_DIGITS}) estimate, any_value(round(stationary, {FIXED_DIGITS})) stationary from dr join st using (word_uid) group by 1",
        "streamed_samples": _with(base) + f", one as (select sample_tag, step, string_agg(cast(district_id as varchar), '.' order by p) plan_vector, row_number() over (partition by sample_tag order by step) - 1 place from asg where step > {BURN_IN} group by 1, 2) select sample_tag, step, place, plan_vector from one where place < {CHAIN}",
        "ingested_stationary": _with(filed, one, words(), STRATA) + "select word_uid, word_str, " + _r("stationary", "stationary") + " from st",
        "flux_fixed_point": _with(*strata, FIXED, recursive=True) + f"select word_uid, component, round(stationary / sum(stationary) over (partition by component), {FIXED_DIGITS}) z from st join comp using (word_uid)",
    }


#: Cap of the query plan_words_capped.
CAP = 500
