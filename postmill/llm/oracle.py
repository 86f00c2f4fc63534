"""SQL of the queries of this subpackage that SQL can express on whole tables."""

# Words as in p8: tags to spaces, lower case, runs of letters and digits; the runs of 12 words are
# the lists' slices, compared as text.
_RUNS = r"""
select distinct {id}, array_to_string(w[i + 1 : i + 12], ' ') as run
from (select {id}, w, unnest(range(len(w) - 11)) as i
      from (select {id}, regexp_extract_all(lower(regexp_replace({text}, '<[^>]*>', ' ', 'g')), '[\p{{L}}\p{{N}}]+') as w from {table})
      where len(w) >= 12)
"""

SQL = {
    "p8_found": "with a as (" + _RUNS.format(id="doc_id", text="text", table="documents") + "), b as (" + _RUNS.format(id="item_id", text="passage", table="eval_items") + ") select distinct doc_id, item_id from a join b using (run)",
    # all pairs that share a sequence at all, counted: quadratic in the rows of common sequences, for small tables
    "p2_found": r"""
with w as (select row_id, regexp_extract_all(regexp_replace(lower(coalesce(title, '') || ' ' || coalesce(description, '')), '<[^>]*>', ' ', 'g'), '[a-z0-9]+') as w from raw_jobs),
s as (select distinct row_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select row_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 20)),
n as (select row_id, count(*) as c from s group by 1),
p as (select a.row_id as row_a, b.row_id as row_b, count(*) as k from s a join s b on a.g = b.g and a.row_id < b.row_id group by 1, 2)
select row_a, row_b from p join n x on x.row_id = row_a join n y on y.row_id = row_b where 2 * k >= x.c + y.c - k
""",
}
