"""SQL counterparts of the registered queries, written independently of them."""

from __future__ import annotations

from kinmat.constants import DEFAULT_KS, DEFAULT_SEED
from kinmat.registered.queries import (
    CAP,
    COARSE,
    FAULTS,
    FINE,
    N_COLS,
    N_EXTREME,
    N_FULL,
    N_FULL_EXTREME,
    N_ROWS,
    SEARCH_EVERY,
    SKETCH,
    SKETCH_BLOCKS,
    SKETCH_WHOLE,
    TINY,
)

_KS = ", ".join(f"({k})" for k in DEFAULT_KS)


def _store(name: str, scale: int, printed: bool = False) -> str:
    norm = "sqrt(list_sum(list_transform(v, lambda x: x::bigint * x::bigint))::double / len(v)::double)"
    if printed:
        norm = f"round({norm}, 1)"
    return f"""
{name}_v as (select vec_id::bigint idx, vec_id::varchar acc,
  list_transform(embedding, lambda x: round(x::double * {scale})::int) v from embeddings),
{name} as (select idx, acc, v, len(v)::bigint d, {norm} norm from {name}_v)"""


def _pairs(name: str, rows: str, cols: str, self_pairs: bool = False) -> str:
    """All pairs of two id lists with existence, raw and quantised value."""
    condition = "true" if self_pairs else "r.idx <> c.idx"
    return f"""
{name}_dot as (select r.idx row_idx, c.idx col_idx, r.acc row_acc, c.acc col_acc, r.d d,
  r.norm * r.norm ni, c.norm * c.norm nj,
  list_dot_product(r.v::double[], c.v::double[])::bigint dot from {rows} r join {cols} c on {condition}),
{name}_all as (select *, (dot // d)::double > 0.05::double * (ni + nj) found,
  least((dot::double / d::double) / (ni + nj - dot::double / d::double), 1.0::double) j from {name}_dot),
{name} as (select row_idx, row_acc, col_idx, col_acc, j jaccard_raw, round(j * 255)::int jaccard_quantized
  from {name}_all where found)"""


def _asked(store: str) -> str:
    """The rows in which two runs are compared."""
    return f"(select * from {store} where idx % {SEARCH_EVERY} = 0)"


def _decoded(name: str, store: str, rows: str | None = None) -> str:
    return _pairs(f"{name}_p", rows or store, store, True) + f""",
{name} as (select row_acc, row_idx, col_idx, col_acc id, jaccard_quantized::double / 255::double jaccard from {name}_p)"""


def _sample(name: str, store: str, low: int, high: int) -> str:
    return f"""
{name} as (select * exclude (pos) from (select *, row_number() over (
  order by md5('{DEFAULT_SEED}:' || idx::varchar), idx) pos from {store}) where pos > {low} and pos <= {high})"""


def _extreme(name: str, store: str, n: int) -> str:
    return f"""
{name} as (select * exclude (lo, hi) from (select *, row_number() over (order by norm, idx) lo,
  row_number() over (order by norm desc, idx desc) hi from {store}) where lo <= {n} or hi <= {n})"""


_LABELLED = "labelled as (select distinct doc_id::varchar acc from labels)"
_TARGETS = _LABELLED + ", targets as (select s.idx, s.acc from fine s join labelled l on s.acc = l.acc)"
_FINE = _store("fine", FINE)
_COARSE = _store("coarse", COARSE)
_TINY = _store("tiny", TINY)
_ROWS_COLS = _sample("srows", "fine", 0, N_ROWS) + "," + _sample("scols", "fine", N_ROWS, N_ROWS + N_COLS)
_TRUTH_RANDOM = f"{_FINE},{_ROWS_COLS},{_pairs('pt', 'srows', 'scols')}"
_TRUTH_COLUMNS = "row_idx, row_acc, col_idx, col_acc, jaccard_raw, jaccard_quantized"
_TRUTH_ALL = f"{_FINE},{_pairs('truth', 'fine', 'fine')}"


def _pair_truth(ctes: str, name: str) -> str:
    return f"""with {ctes}
select row_idx, col_idx, row_acc, col_acc, found::int should_exist,
  case when found then j else -1 end jaccard_raw,
  case when found then round(j * 255)::int else -1 end jaccard_quantized from {name}_all"""


_SLICE_CHECK = """
verdicts as (select p.row_acc, p.col_acc, p.found::int should_exist,
  case when p.found then round(p.j * 255)::int end jaccard_quantized,
  case when t.acc is not null then coalesce(d.jaccard, 0) end cell,
  case when t.acc is null then 'row_or_col_not_in_slice'
    when p.found and d.jaccard is null then 'should_exist_but_missing'
    when not p.found and d.jaccard is not null then 'should_not_exist_but_found'
    when p.found and round(d.jaccard * 255)::int = round(p.j * 255)::int then 'match'
    when p.found then 'value_mismatch' else 'both_absent_ok' end verdict
  from pt_all p left join dec d on d.row_acc = p.row_acc and d.id = p.col_acc
  left join targets t on t.acc = p.col_acc)
"""
_SLICE = f"with {_TRUTH_RANDOM}, {_COARSE},{_decoded('dec', 'coarse')}, {_TARGETS},{_SLICE_CHECK}"
_STAGE_PAIRS = f"with {_TRUTH_RANDOM}, {_COARSE},{_decoded('dec', 'coarse')}, targets as (select * from scols),{_SLICE_CHECK}"
_STAGE_EXTREME = f"""with {_FINE},{_extreme('s', 'fine', N_EXTREME)},{_pairs('pt', 's', 's')}, {_COARSE},{_decoded('dec', 'coarse')},
targets as (select * from s),{_SLICE_CHECK}"""
_PROBLEMS = """select row_acc, col_acc, verdict issue from verdicts
where verdict not in ('match', 'both_absent_ok')"""
_SLICE_COUNTS = """select count(*) filter (verdict = 'should_exist_but_missing') should_exist_but_missing,
count(*) filter (verdict = 'should_not_exist_but_found') should_not_exist_but_found, count(*) filter (verdict = 'value_mismatch') value_mismatch,
count(*) filter (verdict = 'match') "match", count(*) filter (verdict = 'both_absent_ok') both_absent_ok,
count(*) filter (verdict = 'row_or_col_not_in_slice') row_or_col_not_in_slice, count(*) total_pairs,
count(*) filter (verdict not in ('match', 'both_absent_ok')) total_problems from verdicts"""

_ROW_CHECK = """
present as (select distinct row_acc from dec),
others as (select * from dec where id <> row_acc),
joined as (select coalesce(t.row_acc, d.row_acc) accession, coalesce(t.col_acc, d.id) neighbor,
  t.jaccard_raw expected, d.jaccard actual from truth t full outer join others d
  on t.row_acc = d.row_acc and t.col_acc = d.id),
mm as (select accession, neighbor, case when actual is null then 'missing' when expected is null then 'extra'
    else 'value_mismatch' end issue, expected, actual from joined
  where accession in (select row_acc from present)
    and (expected is null or actual is null or abs(expected - actual) > 1.0::double / 255::double)
  union all select distinct row_acc, null, 'row_missing', null::double, null::double from truth
  where row_acc not in (select row_acc from present))
"""
_ROW_MISMATCHES = f"with {_TRUTH_ALL}, {_COARSE},{_decoded('dec', 'coarse')},{_ROW_CHECK}"


def _faulty(name: str, run: int) -> str:
    """The fine decoded rows ``dec0`` with the faults of a run."""
    return f"""
{name}_n as (select row_acc, id, jaccard, row_acc::bigint r, id::bigint c from dec0),
{name} as (select row_acc, id, case when (r * 5 + c * 3) % 53 = {run} then jaccard + 3::double / 255::double else jaccard end jaccard
    from {name}_n where not (r % {FAULTS[run]} = 1 or (r = c and r % 19 = 3) or (r * 7 + c) % 41 = {run})
  union all select acc, ((select max(idx) from fine) - idx)::varchar, 0.5::double from fine
    where idx % 11 = {run} and idx % {FAULTS[run]} <> 1
      and (acc, ((select max(idx) from fine) - idx)::varchar) not in (select row_acc, id from dec0))"""


_FAULTY = f"{_TRUTH_ALL},{_decoded('dec0', 'fine')},{_faulty('dec', 0)}"
_FAULTY_ROWS = f"with {_FAULTY},{_ROW_CHECK}"

_DIFFERENCES = """
has as (select s.acc, s.acc in (select row_acc from a) has_a, s.acc in (select row_acc from b) has_b from {store} s),
j as (select coalesce(a.row_acc, b.row_acc) accession, coalesce(a.id, b.id) neighbor, a.jaccard value_a, b.jaccard value_b
  from a full outer join b on a.row_acc = b.row_acc and a.id = b.id)
select accession, neighbor, case when value_b is null then 'only_a' when value_a is null then 'only_b' else 'value_differs' end issue,
  value_a, value_b from j join has on has.acc = j.accession
  where has_a and has_b and value_a is distinct from value_b
union all select acc, null, case when has_a then 'row_only_a' else 'row_only_b' end, null, null from has where has_a <> has_b"""

_SELF_CHECK = """
rows_of as (select row_acc, max(case when id = row_acc then jaccard end) self_jaccard from dec group by 1),
status as (select s.acc accession, r.self_jaccard, case when r.row_acc is null then 'no_row'
  when r.self_jaccard is null then 'self_missing' when abs(r.self_jaccard - 1) > 1e-6::double then 'self_not_one' else 'ok' end status
  from {store} s left join rows_of r on r.row_acc = s.acc)
"""
_SELF = f"with {_store('tiny', TINY, True)},{_decoded('dec', 'tiny')},{_SELF_CHECK.format(store='tiny')}"

_LISTS_CHECK = """lists as (select row_acc, k, id, jaccard from (select *, row_number() over (
  partition by row_acc order by jaccard desc, id) rd from dec where id <> row_acc) join ks on rd <= k),
present as (select distinct row_acc, k from dec cross join ks)"""
_LISTS_FUNCTION = """tops as (select row_acc, k, id, jaccard from (select *, row_number() over (
  partition by row_acc order by id = row_acc desc, jaccard desc, col_idx) rank from dec) join ks on rank <= k + 1),
lists as (select * from tops where id <> row_acc),
present as (select distinct row_acc, k from tops)"""


def _topk(lists: str, sides: str = f"{_TRUTH_ALL}, {_COARSE},{_decoded('dec', 'coarse')}", wanted: str = "fine") -> str:
    return f"""with {sides},
ks(k) as (values {_KS}), {lists},
t as (select *, row_number() over (partition by row_acc order by jaccard_quantized desc, jaccard_raw desc, col_idx) rn,
  count(*) over (partition by row_acc) n_gt from truth),
b as (select row_acc, k, max(case when rn = k then jaccard_quantized end) qb, max(case when rn = k then jaccard_raw end) jb
  from t cross join ks group by row_acc, k),
c as (select t.row_acc, b.k, t.col_acc, t.jaccard_raw j, t.jaccard_quantized q, t.rn, t.n_gt, b.qb,
  t.n_gt > b.k and abs(t.jaccard_raw - b.jb) <= 1.0::double / 255::double amb from t join b on t.row_acc = b.row_acc),
pool as (select *, n_gt <= k or (q > qb and not amb) must,
  n_gt > k and not (q > qb and not amb) and (q = qb or amb) tie from c),
u as (select coalesce(p.row_acc, x.row_acc) row_acc, coalesce(p.k, x.k) k, p.col_acc pc, x.id xc, p.j, x.jaccard jd,
  p.must, p.tie, p.rn <= p.k own from pool p full outer join lists x on p.row_acc = x.row_acc and p.k = x.k and p.col_acc = x.id),
g as (select row_acc, k, count(pc) n_gt, count(xc) n_dec, count(case when own then 1 end) n_own,
  count(case when own and xc is not null then 1 end) n_hit, count(case when must and xc is null then 1 end) miss,
  count(case when xc is not null and not coalesce(must or tie, false) then 1 end) leak,
  count(case when must and xc is not null and abs(j - jd) > 1.0::double / 255::double then 1 end) bad from u group by row_acc, k),
reasons as (select s.acc accession, ks.k, pr.row_acc is not null present, coalesce(n_gt, 0) n_gt, coalesce(n_dec, 0) n_dec,
  coalesce(n_own, 0) n_own, coalesce(n_hit, 0) n_hit,
  case when pr.row_acc is null then case when coalesce(n_gt, 0) = 0 then 'none' else 'row_missing' end
    when coalesce(miss, 0) > 0 then 'required_missing'
    when coalesce(n_gt, 0) <= ks.k and coalesce(n_dec, 0) > coalesce(n_gt, 0) then 'too_many'
    when coalesce(leak, 0) > 0 then 'below_boundary' when coalesce(bad, 0) > 0 then 'value_mismatch' else 'none' end reason
  from {wanted} s cross join ks left join present pr on pr.row_acc = s.acc and pr.k = ks.k
  left join g on g.row_acc = s.acc and g.k = ks.k),
status as (select accession, k, case when reason <> 'none' then 'fail'
    when not present or (n_dec = n_hit and n_own = n_hit) then 'exact' else 'tie' end status,
  reason, n_dec = least(k, n_gt) size_ok from reasons)
"""


_STATUS = "select * from status"
_TOPK_SUMMARY = """select k, count(*) filter (status = 'exact') n_exact, count(*) filter (status = 'tie') n_tie,
  count(*) filter (status = 'fail') n_fail, count(*) filter (status <> 'fail') n_pass from status group by k"""

# K-mers are cut inside overlapping segments, since a substring of a long text is slow.
_KMERS = """
seg as (select doc_id, substring(text, s * 500 + 1, 520) seg from
  (select doc_id, text, unnest(range(0, length(text) // 500 + 1)) s from documents)),
km as (select distinct doc_id, kmer from (select doc_id,
  unnest(list_transform(range(1, least(500, length(seg) - 20) + 1), lambda i: substring(seg, i, 21))) kmer from seg)),
sz as (select d.doc_id, count(k.kmer) size from documents d left join km k using (doc_id) group by 1)"""
_COPIES = """
cg as (select doc_id, min(doc_id) over (partition by text) rep_id, count(*) over (partition by text) copies from documents)"""
_DOC_PAIRS = f"""{_KMERS},
hits as (select a.doc_id a, b.doc_id b, count(*) inter from km a join km b on a.kmer = b.kmer and a.doc_id <> b.doc_id group by 1, 2),
dp as (select h.a, h.b, h.inter, x.size size_a, y.size size_b from hits h join sz x on x.doc_id = h.a join sz y on y.doc_id = h.b
  where h.inter::double > 0.05::double * (x.size + y.size)::double)"""
_DEGREE = f"""{_DOC_PAIRS},
deg as (select d.doc_id idx, d.doc_id::varchar acc, count(p.a) degree from documents d left join dp p on p.a = d.doc_id group by 1, 2)"""
_REPORT = """
report as (select acc accession, category from (select *, row_number() over (partition by category order by idx) nth from
    (select *, case degree when 0 then 'zero_neighbor' when 1 then 'single_neighbor' end category from deg) where category is not null)
  where nth <= {cap}
  union all select min_by(acc, idx), 'row0' from deg union all select max_by(acc, idx), 'last_row' from deg)"""
_ALL = 1 << 60
_EDGES = f"{_DEGREE},{_REPORT.format(cap=_ALL)}"
_MATRIX_DEGREE = f"""{_TINY},{_decoded('dec', 'tiny')},
deg as (select s.idx, s.acc, count(d.id) degree from tiny s left join dec d on d.row_acc = s.acc and d.id <> s.acc group by 1, 2)"""
_SAMPLED = f"{_FINE},{_sample('wanted', 'fine', 0, N_FULL)},{_pairs('truth', 'wanted', 'fine')}, {_COARSE},{_decoded('dec_all', 'coarse')}, dec as (select * from dec_all where row_acc in (select acc from wanted))"

_EXTREME_ROWS = f"{_FINE},{_extreme('wanted', 'fine', N_FULL_EXTREME)},{_pairs('truth', 'wanted', 'fine')}, {_COARSE},{_decoded('dec_all', 'coarse')}, dec as (select * from dec_all where row_acc in (select acc from wanted))"
_WIDE_CELLS = f"""with {_COARSE},{_decoded('dec', 'coarse')}
select s.acc row_acc, c.acc col_acc, coalesce(d.jaccard, 0::double) cell from coarse s
cross join (select acc from coarse where acc in (select n_nationkey::varchar from nation)) c
left join dec d on d.row_acc = s.acc and d.id = c.acc"""

_MANIFEST = """
eq as (select min(doc_id) low, max(doc_id) high, count(*) n from documents where length(text) > 20 group by text having count(*) > 1),
sl as (select min(doc_id) low, max(doc_id) high from documents group by length(text)
  having count(*) = 2 and min(text) <> max(text)),
pr as (select case when n = 2 then 'near_identical' else 'background' end grp, low, high from eq
  union all select 'boundary_threshold', low, high from sl),
man as (select grp, low acc, 'base' role, high partner from pr union all select grp, high, 'mutant', low from pr
  union all select 'zero_neighbor', doc_id, 'single', null from documents where length(text) < 21)"""
_EXPECTATIONS = f"""with {_DEGREE},{_MANIFEST},
known as (select m.*, g.degree, case grp when 'boundary_threshold' then null when 'zero_neighbor' then 0 else 1 end expected,
  p.a is not null paired from man m join deg g on g.idx = m.acc left join dp p on p.a = m.acc and p.b = m.partner)
select grp "check", acc::varchar accession, expected::varchar expected, degree::varchar "found",
  case when degree = expected and (grp <> 'near_identical' or paired) then 'OK' else 'FAIL' end status
  from known where expected is not null
union all select 'boundary_threshold', null, 'both sides', (count(*) filter (degree = 1))::varchar || '/' || (count(*) filter (degree <> 1))::varchar,
  case when count(*) filter (degree = 1) > 0 and count(*) filter (degree <> 1) > 0 then 'OK' else 'WARN' end
  from known where grp = 'boundary_threshold' and role = 'base' having count(*) > 0
union all select 'row0_marker', min(doc_id)::varchar, min(doc_id)::varchar, min(doc_id)::varchar, 'OK' from documents
union all select 'last_row_marker', max(doc_id)::varchar, max(doc_id)::varchar, max(doc_id)::varchar, 'OK' from documents"""


def _sketch(shape: dict[str, int]) -> str:
    dim, limit = shape["dim"], (1 << 32) // shape["scaled"]
    return f"""with {_KMERS},
kept as (select doc_id, kmer from km where ('0x' || substr(md5(kmer), 1, 8))::bigint < {limit}),
marks as (select doc_id, block, md5(kmer || '|' || block::varchar) h from kept cross join range(0, {dim // 64}) r(block)),
comp as (select doc_id, block * 64 + bit component,
  sum(2 * ((('0x' || substr(h, 17 + 8 * (bit // 32), 8))::bigint >> (31 - bit % 32)) & 1) - 1)::bigint val
  from marks cross join range(0, 64) b(bit) group by 1, 2),
counts as (select doc_id, count(*) n from kept group by 1)
select d.doc_id, coalesce(n, 0)::bigint n_kept, string_agg(coalesce(val, 0)::varchar, ',' order by c.component) vector
from documents d cross join range(0, {dim}) c(component)
left join comp on comp.doc_id = d.doc_id and comp.component = c.component
left join counts on counts.doc_id = d.doc_id group by d.doc_id, n"""


def _wide() -> str:
    cells = ", ".join(
        f"""coalesce(max(case when d.id = '{i}' then d.jaccard end), 0) as "{i}\"""" for i in range(25)
    )
    return f"""with {_COARSE},{_decoded('dec', 'coarse')}
select s.acc row_acc, {cells} from coarse s left join dec d on d.row_acc = s.acc
and d.id in (select n_nationkey::varchar from nation) group by s.acc"""


ORACLE: dict[str, str] = {
    "sample_rows": f"with {_FINE},{_sample('s', 'fine', 0, N_FULL)} select idx, acc from s",
    "sample_disjoint": f"""with {_FINE},{_ROWS_COLS}
select idx, acc, 'row' part from srows union all select idx, acc, 'col' from scols""",
    "sample_extreme": f"with {_FINE},{_extreme('s', 'fine', N_EXTREME)} select idx, acc, norm from s",
    "targets_resolve": f"with {_FINE}, {_TARGETS} select idx, acc from targets",
    "targets_unknown": f"with {_FINE}, {_LABELLED} select acc from labelled where acc not in (select acc from fine)",
    "pair_truth_random": _pair_truth(_TRUTH_RANDOM, "pt"),
    "pair_truth_extreme": _pair_truth(
        f"{_FINE},{_extreme('s', 'fine', N_EXTREME)},{_pairs('pt', 's', 's')}", "pt"
    ),
    "full_rows_random": f"""with {_FINE},{_sample('s', 'fine', 0, N_FULL)},{_pairs('t', 's', 'fine')}
select {_TRUTH_COLUMNS} from t""",
    "full_rows_tiled": f"""with {_FINE},{_sample('s', 'fine', 0, N_FULL)},{_pairs('t', 's', 'fine')}
select {_TRUTH_COLUMNS} from t""",
    "full_rows_extreme": f"""with {_FINE},{_extreme('s', 'fine', N_FULL_EXTREME)},{_pairs('t', 's', 'fine')}
select {_TRUTH_COLUMNS} from t""",
    "full_rows_targets": f"""with {_FINE}, {_TARGETS}, s as (select * from fine where idx in (select idx from targets)),
{_pairs('t', 's', 'fine')} select {_TRUTH_COLUMNS} from t""",
    "full_rows_all": f"with {_TRUTH_ALL} select {_TRUTH_COLUMNS} from truth",
    "all_pairs_matrix": f"""with {_FINE},{_pairs('t', 'fine', 'fine', True)}
select row_idx, col_idx, jaccard_quantized::smallint q from t""",
    "slice_long": f"""with {_FINE},{_ROWS_COLS}, {_COARSE},{_decoded('dec', 'coarse')}
select r.acc row_acc, c.acc col_acc, coalesce(d.jaccard, 0) cell from srows r cross join scols c
left join dec d on d.row_acc = r.acc and d.id = c.acc""",
    "slice_wide": _wide(),
    "neighbours_rows": f"with {_COARSE},{_decoded('dec', 'coarse')} select row_acc, id, jaccard from dec",
    "neighbours_targets": f"""with {_COARSE},{_decoded('dec', 'coarse')}, {_LABELLED}
select row_acc, id, jaccard from dec where row_acc in (select acc from labelled)""",
    "neighbour_records": f"""with {_COARSE},{_decoded('dec', 'coarse')},
top as (select *, row_number() over (partition by row_acc order by id = row_acc desc, jaccard desc, col_idx) rank from dec)
select row_acc id, count(*)::int n, string_agg(id, ',' order by rank) neighbor_ids, max(jaccard) best_jaccard
from top where rank <= 10 group by row_acc""",
    "topk_10": f"""with {_COARSE},{_decoded('dec', 'coarse')}
select row_acc, rank::int rank, id, jaccard from (select *, row_number() over (
  partition by row_acc order by id = row_acc desc, jaccard desc, col_idx) rank from dec) where rank <= 10""",
    "topk_multi": f"""with {_COARSE},{_decoded('dec', 'coarse')}, ks(k) as (values {_KS})
select row_acc, k, rank::int rank, id, jaccard from (select *, row_number() over (
  partition by row_acc order by id = row_acc desc, jaccard desc, col_idx) rank from dec) join ks on rank <= k""",
    "topk_boundary_pools": f"""with {_TRUTH_ALL}, ks(k) as (values {_KS}),
t as (select *, row_number() over (partition by row_acc order by jaccard_quantized desc, jaccard_raw desc, col_idx) rn,
  count(*) over (partition by row_acc) n_gt from truth),
b as (select row_acc, n_gt, k, max(case when rn = k and n_gt > k then jaccard_quantized end) q_b,
  max(case when rn = k and n_gt > k then jaccard_raw end) raw_b from t cross join ks group by row_acc, n_gt, k),
f as (select b.*, b.q_b is not null bounded, t.jaccard_quantized > b.q_b above, t.jaccard_quantized = b.q_b lev,
  abs(t.jaccard_raw - b.raw_b) <= 1.0::double / 255::double amb from t join b on t.row_acc = b.row_acc)
select row_acc, n_gt, k, q_b, raw_b, count(*) filter (not bounded or (above and not amb)) n_must,
  count(*) filter (bounded and not (above and not amb) and (lev or amb)) n_tie, count(*) filter (bounded and amb) n_ambiguous
from f group by row_acc, n_gt, k, q_b, raw_b""",
    "compare_slice_verdicts": _SLICE + "select * from verdicts",
    "compare_slice_mismatches": _SLICE + _PROBLEMS,
    "compare_slice_summary": _SLICE + _SLICE_COUNTS,
    "stage_random_pairs": _STAGE_PAIRS + _SLICE_COUNTS,
    "stage_extreme_pairs": _STAGE_EXTREME + _PROBLEMS,
    "compare_rows_mismatches": _ROW_MISMATCHES + "select * from mm",
    "compare_rows_summary": _ROW_MISMATCHES + """select (select count(*) from fine) rows_checked,
(select count(*) from truth) truth_entries, count(*) mismatches, count(*) filter (issue = 'row_missing') n_row_missing,
count(*) filter (issue = 'missing') n_missing, count(*) filter (issue = 'extra') n_extra,
count(*) filter (issue = 'value_mismatch') n_value_mismatch from mm""",
    "self_pair_status": _SELF + _STATUS,
    "self_pair_anomalies": _SELF + "select * from status where status in ('self_missing', 'self_not_one')",
    "missing_rows": f"""with {_TINY},{_decoded('dec', 'tiny')}
select acc accession from tiny where acc not in (select row_acc from dec)""",
    "topk_check_status": _topk(_LISTS_CHECK) + _STATUS,
    "topk_check_summary": _topk(_LISTS_CHECK) + _TOPK_SUMMARY,
    "topk_function_status": _topk(_LISTS_FUNCTION) + _STATUS,
    "topk_function_summary": _topk(_LISTS_FUNCTION) + _TOPK_SUMMARY,
    "diff_runs_mismatches": f"with {_FINE},{_decoded('dec0', 'fine')},{_faulty('a', 0)},{_faulty('b', 1)},{_DIFFERENCES.format(store='fine')}",
    "stage_subset_differences": f"with {_store('fine', TINY)}, asked as {_asked('fine')},{_decoded('a', 'fine', 'asked')}, {_COARSE},{_decoded('b', 'coarse', _asked('coarse'))},{_DIFFERENCES.format(store='asked')}",
    "split_rows_with_empty": f"""with {_TRUTH_RANDOM}
select i.acc row_acc, p.col_acc, p.jaccard_raw from (select acc from srows union select acc from scols) i
left join pt p on p.row_acc = i.acc""",
    "kmer_sets": f"""with {_KMERS}
select s.doc_id, s.size::int n_kmers, md5(coalesce(string_agg(k.kmer, '|' order by k.kmer), '')) set_digest
from sz s left join km k on k.doc_id = s.doc_id group by 1, 2""",
    "copy_groups": f"with {_COPIES} select doc_id, rep_id, copies from cg",
    "kmer_jaccard_pairs": f"""with {_DOC_PAIRS}, {_COPIES}
select p.a id_a, p.b id_b, p.size_a::int size_a, p.size_b::int size_b, x.copies copies_a, y.copies copies_b, p.inter,
  p.inter::double / (p.size_a + p.size_b - p.inter)::double jaccard
from dp p join cg x on x.doc_id = p.a and x.rep_id = p.a join cg y on y.doc_id = p.b and y.rep_id = p.b where p.a < p.b""",
    "neighbour_degree": f"with {_DEGREE} select idx, acc, degree from deg",
    "edge_case_report": f"with {_EDGES} select accession, category from report",
    "edge_case_report_capped": f"with {_DEGREE},{_REPORT.format(cap=CAP)} select accession, category from report",
    "edge_case_targets": f"with {_EDGES} select distinct accession acc from report",
    "edge_category_counts": f"""with {_DEGREE}
select case degree when 0 then 'zero_neighbor' else 'single_neighbor' end category, count(*) "count"
from deg where degree < 2 group by 1""",
    "expectation_status": _EXPECTATIONS,
    "sketch_vectors": _sketch(SKETCH),
    "sketch_vectors_blocks": _sketch(SKETCH_BLOCKS),
    "sketch_vectors_whole": _sketch(SKETCH_WHOLE),
    "faulty_rows_mismatches": _FAULTY_ROWS + "select * from mm",
    "faulty_self_status": f"with {_FAULTY},{_SELF_CHECK.format(store='fine')}" + _STATUS,
    "faulty_topk_status": _topk(_LISTS_CHECK, _FAULTY) + _STATUS,
    "decoded_degree": f"with {_MATRIX_DEGREE} select idx, acc, degree from deg",
    "matrix_edge_cases": f"with {_MATRIX_DEGREE},{_REPORT.format(cap=_ALL)} select accession, category from report",
    "category_report_round_trip": f"with {_MATRIX_DEGREE},{_REPORT.format(cap=_ALL)} select accession, category from report",
    "report_head": _ROW_MISMATCHES + "select * from mm order by accession, neighbor limit 20",
    "sorted_lists": f"""with {_TRUTH_ALL}
select row_idx, col_idx, (row_number() over (partition by row_idx order by jaccard_raw desc, col_idx))::int "position" from truth""",
    "accessions_round_trip": f"with {_FINE} select acc from fine",
    "norms_round_trip": f"with {_FINE} select idx, acc, norm from fine",
    "pair_truth_round_trip": f"""with {_TRUTH_RANDOM}
select row_idx, col_idx, row_acc, col_acc, found::int should_exist, case when found then j end jaccard_raw,
  case when found then round(j * 255)::int end jaccard_quantized from pt_all""",
    "row_lists_round_trip": f"""with {_FINE},{_sample('s', 'fine', 0, N_FULL)},{_pairs('t', 's', 'fine')}
select {_TRUTH_COLUMNS} from t""",
    "split_lists_round_trip": f"""with {_TRUTH_RANDOM}
select i.acc row_acc, p.col_acc, p.jaccard_raw from (select acc from srows union select acc from scols) i
left join pt p on p.row_acc = i.acc""",
    "decoded_round_trip": f"""with {_FINE}, {_COARSE},{_decoded('dec', 'coarse')},{_sample('s', 'fine', 0, N_FULL)},
top as (select *, row_number() over (partition by row_acc order by id = row_acc desc, jaccard desc, col_idx) rank from dec
  where row_acc in (select acc from s))
select row_acc, id, jaccard from top where rank <= 10""",
    "slice_round_trip": _WIDE_CELLS,
    "printed_matrix_round_trip": _WIDE_CELLS,
    "mismatch_report_round_trip": _SLICE + _PROBLEMS,
    "manifest_round_trip": f"""with {_MANIFEST} select acc::varchar accession, grp, role, partner::varchar paired_with from man
union all select min(doc_id)::varchar, 'row0_marker', 'single', null from documents
union all select max(doc_id)::varchar, 'last_row_marker', 'single', null from documents""",
    "stage_full_rows_mismatches": f"with {_SAMPLED},{_ROW_CHECK}select * from mm",
    "stage_extreme_rows_mismatches": f"with {_EXTREME_ROWS},{_ROW_CHECK}select * from mm",
    "stage_subset_mismatches": f"""with {_MATRIX_DEGREE},{_REPORT.format(cap=_ALL)}, {_FINE},
known as (select * from fine where acc in (select accession from report)),{_pairs('truth', 'known', 'fine')},
dec_known as (select * from dec where row_acc in (select acc from known)),{_ROW_CHECK.replace('from dec', 'from dec_known')}select * from mm""",
    "vectors_round_trip": f"with {_FINE} select idx, acc, norm, array_to_string(v, ',') vector from fine",
    "dimension_round_trip": f"with {_FINE} select len(v)::int dimension, count(*) n from fine group by 1",
    "row_files_round_trip": f"""with {_FINE}, {_COARSE},{_decoded('dec', 'coarse')},{_sample('s', 'fine', 0, N_FULL)}
select row_acc, id, jaccard from dec where row_acc in (select acc from s)""",
    "stage_full_rows_topk": _topk(_LISTS_CHECK, _SAMPLED, "wanted") + _STATUS,
}
