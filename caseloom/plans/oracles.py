"""Plain SQL for the registered queries, used to check them on another engine."""

from __future__ import annotations

from caseloom.config import (ABBREVIATIONS, CATEGORICAL_FEATURES, DEMO_REACTIONS, EMPTY_NARRATIVE, FACTOR_LINE, HIGH_RISK,
                             HIGH_RISK_MARK, LOW_RISK, LOW_RISK_MARK, LOWERS, RAISES, REPORT, REQUEST_DEFAULTS, RISK_POINTS,
                             RISK_REACTIONS, SEED, SERIOUS_OUTCOMES)
from caseloom.functions.hashing import FOLD_SALT, NOISE_SALT, SPLIT_SALT
from caseloom.operators.metrics import THRESHOLDS
from caseloom.operators.statistics import AGE_BANDS, BINS, CORRELATED

_QUARTER = "case when {key} % 2 = 0 then '2022q1' else '2022q2' end"

_TERMS = ", ".join(f"'{term}'" for term in DEMO_REACTIONS)

_SERIOUS = ", ".join(f"'{code}'" for code in SERIOUS_OUTCOMES)

_TABLES = f"""
demo as (
  select o_orderkey as primaryid,
    case when o_orderkey % 17 = 0 then null
         else cast(1 + (o_orderkey * 7 + o_custkey * 13) % 100 as int) end as age,
    case when o_custkey % 20 < 9 then 'M' when o_custkey % 20 < 18 then 'F' else 'UNK' end as sex,
    case when o_orderkey % 29 = 0 then null
         else 30.0e0 + ((o_custkey * 31) % 1701) / 10.0e0 end as wt,
    n_name as occr_country,
    {_QUARTER.format(key="o_orderkey")} as quarter
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
drug as (
  select l_orderkey as primaryid, cast(l_linenumber as bigint) as drug_seq, p_name as drugname,
    case when l_partkey % 23 = 0 then null else lower(p_type) end as route, p_brand as prod_ai,
    case when l_partkey % 31 = 0 then 'unk' else cast(cast(l_quantity * 20 as int) as varchar) end as dose_amt,
    case l_suppkey % 5 when 0 then 'QD' when 1 then 'BID' when 2 then 'TID' when 3 then 'QID' else 'PRN' end as dose_freq,
    cast(1 + (l_partkey * 11 + l_suppkey) % 364 as int) as dur,
    case l_returnflag when 'A' then 'Y' when 'N' then 'N' else 'U' end as dechal,
    case l_linestatus when 'F' then 'Y' else 'N' end as rechal,
    {_QUARTER.format(key="l_orderkey")} as quarter,
    l_linenumber * 1099511627776 + l_partkey as row_order
  from lineitem join part on l_partkey = p_partkey),
reac as (
  select l_orderkey as primaryid,
    ([{_TERMS}])[l_suppkey % 10 + 1] as pt,
    {_QUARTER.format(key="l_orderkey")} as quarter,
    l_linenumber * 1099511627776 + l_suppkey as row_order
  from lineitem),
outc as (
  select o_orderkey as primaryid,
    case o_orderpriority when '1-URGENT' then 'HO' when '2-HIGH' then 'DE' when '3-MEDIUM' then 'OT' else 'RI' end as outc_cod,
    {_QUARTER.format(key="o_orderkey")} as quarter
  from orders where o_orderpriority <> '5-LOW')"""


def _joined(table: str, column: str) -> str:
    return (f"select primaryid, string_agg({column}, ' | ' order by first) as {column} from "
            f"(select primaryid, {column}, min(row_order) as first from {table} group by primaryid, {column}) "
            f"where {column} is not null group by primaryid")


_ROLLUPS = f"""
drug_text as (
  select k.primaryid, k.quarter, coalesce(drugname, '') as drugname, coalesce(route, '') as route,
    coalesce(prod_ai, '') as prod_ai
  from (select distinct primaryid, quarter from drug) k
  left join ({_joined("drug", "drugname")}) using (primaryid)
  left join ({_joined("drug", "route")}) using (primaryid)
  left join ({_joined("drug", "prod_ai")}) using (primaryid)),
reac_text as ({_joined("reac", "pt")}),
drug_ranked as (
  select *, row_number() over (partition by primaryid order by row_order, dose_amt, dose_freq, dur, dechal, rechal) as place,
    cast(max(drug_seq) over (partition by primaryid) as double) as n_drugs
  from drug),
drug_first as (
  select quarter, primaryid, n_drugs as drug_seq, dose_amt, dose_freq, dur, dechal, rechal
  from drug_ranked where place = 1),
flags as (
  select quarter, primaryid, max(case when outc_cod in ({_SERIOUS}) then 1 else 0 end) as serious
  from outc group by quarter, primaryid)"""

_HASH = "((({key} % 2147483647) * {salt} + 12345) % 2147483648)"


def _hash(salt: int, key: str = "primaryid") -> str:
    return _HASH.format(key=key, salt=salt)


_CASES = f"""
cases as (
  select demo.quarter, demo.primaryid, age, sex, wt, occr_country, drugname, route, prod_ai,
    drug_first.drug_seq, dose_amt, dose_freq, dur, dechal, rechal, pt as reactions,
    cast(coalesce(serious, 0) as int) as serious
  from demo left join drug_text using (primaryid) left join drug_first using (primaryid)
  left join reac_text using (primaryid) left join flags using (primaryid)),
risky as (
  select *, case when age > 65 then {RISK_POINTS["age"]}e0 else 0.0e0 end + case when drug_seq > 5 then {RISK_POINTS["drugs"]}e0 else 0.0e0 end
      + case when regexp_matches(reactions, '{RISK_REACTIONS}') then {RISK_POINTS["reaction"]}e0 else 0.0e0 end
      + {_hash(NOISE_SALT)} / 2147483648.0e0 * {RISK_POINTS["noise"]}e0 as risk
  from cases),
labelled as (select * exclude (serious, risk), cast(risk > 0.5e0 as int) as serious from risky),
scored as (
  select *, cast(least(999, greatest(1, cast(coalesce(age, 55) * 3 + coalesce(drug_seq, 1) * 40
      + {_hash(SPLIT_SALT)} // 4294967 as int))) as double) / 1000.0e0 as score
  from labelled)"""


def with_cases(body: str) -> str:
    return f"with {_TABLES.strip()},{_ROLLUPS},{_CASES}\n{body}"


# Letters, digits and underscore of any script; every kind of space.
_WORD = r"\p{L}\p{N}_"
_SPACE = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

def clean(text: str) -> str:
    # No look-around here: each match takes its neighbours along, so two passes
    # are needed for terms that share one.
    for short, meaning in ABBREVIATIONS.items():
        for _ in range(2):
            text = (rf"regexp_replace({text}, '(^|[^{_WORD}])(?i:{short})($|[^{_WORD}])', "
                    rf"'\1{meaning}\2', 'g')")
    text = rf"regexp_replace({text}, '[^{_WORD}{_SPACE}\-.,()]', ' ', 'g')"
    return rf"coalesce(lower(trim(regexp_replace({text}, '[{_SPACE}]+', ' ', 'g'))), '')"


_COMBINED = ("concat_ws('. ', 'Drug: ' || drugname, 'Route: ' || route, "
             "'Active ingredient: ' || prod_ai, 'Reactions: ' || reactions)")
_NARRATIVE = f"coalesce(nullif({clean(_COMBINED)}, ''), '{EMPTY_NARRATIVE}')"

_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_DOSE = f"case when regexp_matches(dose_amt, '{_NUMBER}') then cast(dose_amt as double) end"
_NUMERIC = {"age": "cast(age as double)", "wt": "wt", "drug_seq": "drug_seq", "dose_amt": _DOSE, "dur": "cast(dur as double)"}
_CATEGORIES = CATEGORICAL_FEATURES
_FLAGS = f"""cast(coalesce(age, 55) > 65 as int) as is_elderly, cast(coalesce(age, 55) < 18 as int) as is_pediatric,
    cast(coalesce(drug_seq, 1) > 5 as int) as polypharmacy, cast(coalesce({_DOSE}, 0) > 500 as int) as high_dose,
    cast(coalesce(dur, 0) > 90 as int) as long_duration"""

# Statistics over `fit`, values for `cases`.
_FITTED = f"""
fit as (select * from cases where {{condition}}),
numbers as (select {", ".join(f"{body} as {name}" for name, body in _NUMERIC.items())} from fit),
medians as (select {", ".join(f"median({name}) as {name}" for name in _NUMERIC)} from numbers),
stats as (select {", ".join(f"any_value(m.{n}) as med_{n}, avg(coalesce(x.{n}, m.{n})) as mean_{n}, "
                            f"stddev_pop(coalesce(x.{n}, m.{n})) as std_{n}" for n in _NUMERIC)}
  from numbers x cross join medians m),
category_map as (
  select feature, value, cast(row_number() over (partition by feature order by value) - 1 as int) as code from (
    {" union ".join(f"select '{c}' as feature, coalesce({c}, 'UNKNOWN') as value from fit" for c in _CATEGORIES)}))"""


def _fitted(condition: str = "true") -> str:
    return with_cases("").rstrip() + "," + _FITTED.format(condition=condition)


def _scaled(digits: int = 6) -> str:
    return ", ".join(f"round((coalesce({body}, med_{n}) - mean_{n}) / std_{n}, {digits}) as {n}"
                     for n, body in _NUMERIC.items())


def _codes(kind: str) -> str:
    parts = []
    for c in _CATEGORIES:
        lookup = f"(select code from category_map where feature = '{c}' and value = {{}})"
        parts.append(f"cast(coalesce({lookup.format(f'coalesce(cases.{c}, ' + chr(39) + 'UNKNOWN' + chr(39) + ')')}, "
                     f"{lookup.format(chr(39) + 'UNKNOWN' + chr(39))}, 0) as {kind}) as {{}}{c}")
    return ", ".join(parts)


_FEATURE_TABLE = (_fitted() + f"\nselect primaryid, serious, {_scaled()}, {_codes('double').replace('{}', '')}, "
                  + ", ".join(f"cast({f} as double) as {f}" for f in
                              ("is_elderly", "is_pediatric", "polypharmacy", "high_dose", "long_duration"))
                  + f" from (select *, {_FLAGS} from cases) cases cross join stats")

_COUNTS = """
counts as (
  select cast(sum(case when score >= 0.5e0 and serious = 1 then 1 else 0 end) as bigint) as tp,
    cast(sum(case when score >= 0.5e0 and serious = 0 then 1 else 0 end) as bigint) as fp,
    cast(sum(case when score < 0.5e0 and serious = 0 then 1 else 0 end) as bigint) as tn,
    cast(sum(case when score < 0.5e0 and serious = 1 then 1 else 0 end) as bigint) as fn
  from scored)"""
_RATES = """round(coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1,
  round(coalesce(tp * 1e0 / nullif(tp + fp, 0), 0), 6) as precision,
  round(coalesce(tp * 1e0 / nullif(tp + fn, 0), 0), 6) as recall,
  round(coalesce(tn * 1e0 / nullif(tn + fp, 0), 0), 6) as specificity"""

# Rank statistics; `{by}` is empty or "fold, ".
_CURVE = """
levels as (
  select {by}score, cast(sum(serious) as double) as p, cast(sum(1 - serious) as double) as n
  from {source} group by {by}score),
curve as (
  select *, sum(p) over (partition by {part} order by score desc) as found,
    sum(p + n) over (partition by {part} order by score desc) as seen
  from levels)"""
_AUC = "round(sum(n * (found - p / 2)) / (sum(p) * sum(n)), 6) as auc_roc"
_AP = "round(sum(p * found / seen) / sum(p), 6) as auc_pr"

_FOLDED = f"""
folded as (
  select *, cast((row_number() over (partition by serious order by {_hash(FOLD_SALT)}, primaryid) - 1) % 5 as int) as fold
  from scored)"""


def _scored(body: str, *parts: str) -> str:
    return with_cases("").rstrip() + "".join("," + part for part in parts) + "\n" + body


_SWEEP = f"""
grid as (select unnest([{", ".join(f"{t!r}::double" for t in THRESHOLDS)}]) as threshold),
sweep as (
  select threshold, cast(sum(case when score >= threshold and serious = 1 then 1 else 0 end) as bigint) as tp,
    cast(sum(case when score >= threshold and serious = 0 then 1 else 0 end) as bigint) as fp,
    cast(sum(case when score < threshold and serious = 1 then 1 else 0 end) as bigint) as fn
  from scored cross join grid group by threshold),
rated as (select *, round(coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from sweep)"""


_AGE_BAND = "case " + " ".join(f"when age > {low} and age <= {high} then '{name}'" for low, high, name in AGE_BANDS) + " end"
_DEFAULTS = ", ".join(f"{value!r} as {name}" for name, value in REQUEST_DEFAULTS.items())


def _histogram(value: str) -> str:
    return with_cases(f"""
, measured as (select serious, {value}::double as x from cases where {value} is not null),
spans as (select serious, min(x) as lo, max(x) as hi from measured group by serious),
edges as (
  select serious, cast(b.bin as int) as bin, lo + b.bin * ((hi - lo) / {BINS}) as bin_low, lo + (b.bin + 1) * ((hi - lo) / {BINS}) as bin_high
  from spans cross join (select unnest(range({BINS})) as bin) b)
select edges.serious, bin, round(bin_low, 6) as bin_low, round(bin_high, 6) as bin_high, count(x) as n
from edges left join measured on edges.serious = measured.serious and x >= bin_low and (x < bin_high or bin = {BINS} - 1)
group by edges.serious, bin, bin_low, bin_high""")


_BOX = f"""
doses as (select serious, {_DOSE} as x from labelled),
box as (
  select serious, count(x) as n, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.5) as median, quantile_cont(x, 0.75) as q3
  from doses group by serious),
fenced as (
  select doses.serious, x, n, q1, median, q3, x between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside
  from doses join box on doses.serious = box.serious where x is not null)"""

# Middle of the value's bucket, at a relative error of 0.005.
_SKETCHED = ("2 * pow(1.005e0 / 0.995e0, ceil(ln(quantile_disc(x, {share})) / ln(1.005e0 / 0.995e0))) / (1 + 1.005e0 / 0.995e0)")

_PAIRS = [(a, b) for a in CORRELATED for b in CORRELATED]
_CORR_COLUMNS = {**_NUMERIC, "serious": "cast(serious as double)"}
_CORRELATION = with_cases("").rstrip() + f""",
numbers as (select {", ".join(f"{body} as {name}" for name, body in _CORR_COLUMNS.items())} from labelled)
""" + " union all ".join(f"select '{a}' as feature_a, '{b}' as feature_b, "
                         f"round(case when isnan(corr({a}, {b})) then null else corr({a}, {b}) end, 6) as correlation from numbers"
                         for a, b in _PAIRS)

_REPORT_RATES = """
rates as (
  select *, coalesce(tn * 1e0 / nullif(tn + fn, 0), 0) as p0, coalesce(tn * 1e0 / nullif(tn + fp, 0), 0) as r0,
    coalesce(2e0 * tn / nullif(2 * tn + fn + fp, 0), 0) as f0, coalesce(tp * 1e0 / nullif(tp + fp, 0), 0) as p1,
    coalesce(tp * 1e0 / nullif(tp + fn, 0), 0) as r1, coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1,
    tn + fp as n0, tp + fn as n1 from counts)"""
_REPORT_LINES = """
select 'Non-Serious' as label, round(p0, 6) as precision, round(r0, 6) as recall, round(f0, 6) as f1, n0 as support from rates
union all select 'Serious', round(p1, 6), round(r1, 6), round(f1, 6), n1 from rates
union all select 'accuracy', null, null, round((tp + tn) * 1e0 / (n0 + n1), 6), n0 + n1 from rates
union all select 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), n0 + n1 from rates
union all select 'weighted avg', round((p0 * n0 + p1 * n1) / (n0 + n1), 6), round((r0 * n0 + r1 * n1) / (n0 + n1), 6),
  round((f0 * n0 + f1 * n1) / (n0 + n1), 6), n0 + n1 from rates"""

_CELLS = ", ".join(f"{{'place': {i}, 'feature': '{n}', 'value': (coalesce({body}, med_{n}) - mean_{n}) / std_{n}}}"
                   for i, (n, body) in enumerate(_NUMERIC.items()))
_CONTRIBUTIONS = _fitted() + f""",
parts as (select primaryid, score, unnest([{_CELLS}]) as part from scored cross join stats)"""

_THREE = f"""
three as (select serious, score as trees, {_hash(NOISE_SALT)} // 4294967 / 1000.0e0 + 0.25e0 as text from scored),
models as (select 'trees' as model, serious, trees as score from three union all select 'text', serious, text from three
  union all select 'fusion', serious, (trees + text) / 2 from three)"""

_RESENT = """
resent as (
  select primaryid, age, sex, wt, quarter from demo union all
  select primaryid, age + 1, sex, wt, '2022q2' from demo where quarter = '2022q1' and primaryid % 10 = 0),
placed as (select *, row_number() over (partition by primaryid order by quarter) as place from resent)"""

_CASE_COLUMNS = ("quarter, primaryid, age, sex, wt, occr_country, drugname, route, prod_ai, drug_seq, dose_amt, "
                 "dose_freq, dur, dechal, rechal, reactions, serious")


def oracle_sql() -> dict[str, str]:
    """SQL per query name; queries that only a fitted model can answer have none."""
    hash_split, hash_other = _hash(SPLIT_SALT), _hash(FOLD_SALT)
    return {
        "case_assembly": with_cases(f"select {_CASE_COLUMNS} from cases"),
        "raw_quarters": with_cases(
            "select quarter, primaryid, cast(age as double) as age, sex, wt, occr_country, drugname, route, prod_ai, "
            f"drug_seq, {_DOSE} as dose_amt, dose_freq, cast(dur as double) as dur, dechal, rechal, reactions, serious from cases"),
        "raw_line_breaks": f"""with {_TABLES.strip()},
changed as (select * replace (case when row_order % 3 = 0 then 'two' || chr(10) || 'lines $ and "quotes" ' || drugname else drugname end
  as drugname) from drug)
select quarter, primaryid, coalesce(drugname, '') as drugname, coalesce(route, '') as route, coalesce(prod_ai, '') as prod_ai
from (select distinct quarter, primaryid from changed)
  left join ({_joined("changed", "drugname")}) using (primaryid) left join ({_joined("changed", "route")}) using (primaryid)
  left join ({_joined("changed", "prod_ai")}) using (primaryid)""",
        "quarter_by_quarter": with_cases("select * exclude (occr_country) from cases"),
        "stored_cases": with_cases("select * exclude (occr_country) from cases"),
        "drug_rollup": with_cases("select quarter, primaryid, drugname, route, prod_ai from drug_text"),
        "reaction_rollup": with_cases(
            "select quarter, primaryid, pt as reactions from reac_text join (select distinct quarter, primaryid from reac) using (primaryid)"),
        "first_drug": with_cases("select quarter, primaryid, drug_seq, dose_amt, dose_freq, dur, dechal, rechal from drug_first"),
        "serious_flag": with_cases("select quarter, primaryid, serious from flags"),
        "outcome_codes": with_cases(
            f"select primaryid, outc_cod, case when outc_cod in ({_SERIOUS}) then 1 else 0 end as serious from outc"),
        "quarter_union": with_cases("select primaryid, age, sex, case when quarter = '2022q2' then wt end as wt, quarter from demo"),
        "dedup_first": _scored("select primaryid, age, sex, wt, quarter from placed where place = 1", _RESENT),
        "sample_exact": with_cases(f"select primaryid, age, sex, wt, quarter from demo order by {hash_split}, primaryid limit 5000"),
        "row_counts": with_cases("select quarter, count(*) as n from demo group by quarter union all select 'total', count(*) from demo"),
        "preview": with_cases(f"select {_CASE_COLUMNS} from cases order by primaryid limit 5"),
        "narrative": with_cases(f"select primaryid, {_NARRATIVE} as narrative from cases"),
        "narrative_length": with_cases(
            f"select round(avg(len(string_split({_NARRATIVE}, ' '))), 6) as mean_words from cases"),
        "clean_documents": f"select doc_id, {clean('text')} as cleaned from documents",
        "tokens_256": "with cleaned as (select doc_id, " + clean("text") + """ as t from documents),
words as (select doc_id, case when t = '' then [] else string_split(t, ' ') end as w from cleaned)
select doc_id, cast(len(w) as int) as n_words, cast(len(w[1:256]) as int) as n_tokens, array_to_string(w[1:256], ' ') as tokens from words""",
        "risky_documents": f"select doc_id, coalesce(regexp_matches(text, '{RISK_REACTIONS}'), false) as found from documents",
        "numeric_coerce": with_cases(f"select primaryid, drug_seq, dose_amt, {_DOSE} as dose from drug"),
        "engineered_flags": with_cases(f"select primaryid, {_FLAGS} from cases"),
        "numeric_stats": _fitted() + "\n" + " union all ".join(
            f"select '{n}' as feature, round(med_{n}, 6) as median, round(mean_{n}, 6) as mean, round(std_{n}, 6) as std from stats"
            for n in _NUMERIC),
        "scaled_numeric": _fitted() + f"\nselect primaryid, {_scaled()} from cases cross join stats",
        "category_map": _fitted() + "\nselect feature, value, code from category_map",
        "encoded_categories": _fitted() + f"\nselect primaryid, {_codes('int').replace('{}', 'code_')} from cases",
        "encoded_unseen": _fitted("quarter = '2022q1' and sex <> 'UNK'")
        + f"\nselect primaryid, {_codes('int').replace('{}', 'code_')} from cases",
        "feature_table": _FEATURE_TABLE,
        "features_roundtrip": _FEATURE_TABLE,
        "risk_rule": with_cases("select primaryid, round(risk, 6) as risk, cast(risk > 0.5e0 as int) as serious from risky"),
        "risk_labels": _scored(
            "select primaryid, score, cast(score >= 0.5e0 as int) as predicted, "
            f"case when score >= 0.5e0 then '{HIGH_RISK}' else '{LOW_RISK}' end as risk from scored"),
        "split_80_20": with_cases(f"select primaryid, cast({hash_split} // 21474837 < 80 as int) as is_train from demo"),
        "split_random": with_cases(f"select primaryid, cast({hash_other} // 21474837 < 80 as int) as is_train from demo"),
        "stratified_folds": _scored("select primaryid, serious, fold from folded", _FOLDED),
        "confusion_metrics": _scored(f"select tp, fp, tn, fn, {_RATES} from counts", _COUNTS),
        "roc_auc": _scored(f"select {_AUC} from curve", _CURVE.format(by="", source="scored", part="1")),
        "average_precision": _scored(f"select {_AP} from curve", _CURVE.format(by="", source="scored", part="1")),
        "all_metrics": _scored(
            f"select (select {_AUC} from curve) as auc_roc, (select {_AP} from curve) as auc_pr, {_RATES}, 0.5e0 as threshold from counts",
            _COUNTS, _CURVE.format(by="", source="scored", part="1")),
        "threshold_sweep": _scored("select round(threshold, 6) as threshold, tp, fp, fn, f1 from rated", _SWEEP),
        "best_threshold": _scored(
            "select round(threshold, 6) as threshold, f1 from rated order by f1 desc, rated.threshold limit 1", _SWEEP),
        "class_report": _scored(_REPORT_LINES, _COUNTS, _REPORT_RATES),
        "fold_aucs": _scored(f"select fold, {_AUC} from curve group by fold", _FOLDED,
                             _CURVE.format(by="fold, ", source="folded", part="fold")),
        "fold_summary": _scored(
            "select round(avg(a), 6) as mean_auc, round(stddev_pop(a), 6) as std_auc, count(*) as folds from "
            "(select sum(n * (found - p / 2)) / (sum(p) * sum(n)) as a from curve group by fold)",
            _FOLDED, _CURVE.format(by="fold, ", source="folded", part="fold")),
        "log_loss": _scored(
            "select round(avg(-ln(case when serious = 1 then score else 1 - score end)), 6) as log_loss from scored"),
        "target_counts": with_cases("select serious, count(*) as n from cases group by serious"),
        "target_share": with_cases(
            "select serious, case when serious = 1 then 'Serious' else 'Non-Serious' end as class_name, count(*) as n, "
            "round(100e0 * count(*) / (select count(*) from cases), 6) as percent from cases group by serious"),
        "serious_rate": with_cases("select count(*) as n_rows, round(avg(serious), 6) as serious_rate from cases"),
        "sex_crosstab": with_cases(
            "select sex, count(*) filter (serious = 0) as non_serious, count(*) filter (serious = 1) as serious from cases group by sex"),
        "age_histogram": _histogram("age"),
        "weight_histogram": _histogram("wt"),
        "dose_boxplot": _scored(
            "select serious, n, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, "
            "least(min(x) filter (inside), q1) as whisker_low, greatest(max(x) filter (inside), q3) as whisker_high, "
            "count(*) filter (not inside) as n_outliers from fenced group by serious, n, q1, median, q3", _BOX),
        "quantile_sketches": with_cases(f"""
, long as (select unnest([{{'f': 'age', 'x': cast(age as double)}}, {{'f': 'wt', 'x': wt}}, {{'f': 'dose_amt', 'x': {_DOSE}}},
  {{'f': 'dur', 'x': cast(dur as double)}}]) as m from cases),
known as (select m.f as feature, m.x as x from long where m.x is not null),
placed as (select *, row_number() over (partition by feature order by x) as place, count(*) over (partition by feature) as n from known),
wanted as (select feature, n, share, min(x) as x from placed cross join (select unnest([0.05e0, 0.25e0, 0.5e0, 0.75e0, 0.95e0]) as share)
  where place >= greatest(1, ceil(share * n)) group by feature, n, share)
select feature, share, n, case when x = 0 then 0 else
  round(2 * pow(1.01e0 / 0.99e0, ceil(ln(x) / ln(1.01e0 / 0.99e0))) / (1 + 1.01e0 / 0.99e0), 6) end as quantile, true as holds from wanted"""),
        "sketched_boxplot": _scored(
            "select serious, n, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, "
            "least(min(x) filter (inside), q1) as whisker_low, greatest(max(x) filter (inside), q3) as whisker_high, "
            "count(*) filter (not inside) as n_outliers from fenced group by serious, n, q1, median, q3",
            _BOX.replace("count(x) as n, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.5) as median, quantile_cont(x, 0.75) as q3",
                         "count(x) as n, " + ", ".join(_SKETCHED.format(share=p) + f" as {n}" for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))))),
        "stream_repeats": with_cases(
            "select primaryid, drugname, route, prod_ai, reactions, cast(age as double) as age, wt, sex, "
            f"{_DOSE} as dose_amt, dose_freq, cast(dur as double) as dur, {_DEFAULTS} from cases"),
        "value_outliers": """
with box as (select event_type, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3
  from events group by event_type)
select event_type, value as outlier, count(*) as n from events join box using (event_type)
where value < q1 - (q3 - q1) * 1.5e0 or value > q3 + (q3 - q1) * 1.5e0
group by event_type, value""",
        "top_drugs": with_cases("select drugname, count(*) as n from drug group by drugname order by n desc, drugname limit 10"),
        "drug_risk_top10": with_cases(
            "select drugname, count(*) as n, round(avg(coalesce(serious, 0)), 6) as serious_rate "
            "from (select distinct primaryid, drugname from drug) left join flags using (primaryid) "
            "group by drugname order by avg(coalesce(serious, 0)) desc, drugname limit 10"),
        "age_band_risk": with_cases(
            f"select {_AGE_BAND} as age_band, "
            "count(*) as n, round(avg(serious), 6) as serious_rate from cases group by 1 having age_band is not null"),
        "drug_count_risk": with_cases(
            "select drug_seq, count(*) as n, round(avg(serious), 6) as serious_rate from cases where drug_seq is not null group by drug_seq"),
        "correlation_matrix": _CORRELATION,
        "report_wording": _CONTRIBUTIONS + f""",
ranked as (select *, row_number() over (partition by primaryid order by abs(part.value) desc, part.place) as rank from parts)
select primaryid, printf('{REPORT}', case when score >= 0.5e0 then '{HIGH_RISK_MARK}' else '{LOW_RISK_MARK}' end,
  case when score >= 0.5e0 then '{HIGH_RISK}' else '{LOW_RISK}' end, score,
  string_agg(printf('{FACTOR_LINE}', part.feature, part.value, case when part.value > 0 then '{RAISES}' else '{LOWERS}' end),
    chr(10) order by rank)) as report
from ranked where rank <= 5 group by primaryid, score""",
        "null_key_sample": with_cases(f"""
, keyed as (select case when primaryid > (select min(primaryid) from demo) then primaryid end as primaryid, age, sex, wt, quarter from demo),
taken as (select * from keyed order by {_hash(SPLIT_SALT, "coalesce(primaryid, 0)")}, primaryid nulls first limit 5000)
select *, cast({_hash(SPLIT_SALT, "coalesce(primaryid, 0)")} // 21474837 < 80 as int) as is_train from taken"""),
        "combined": _FEATURE_TABLE.replace("select primaryid, serious,", f"select primaryid, {_NARRATIVE} as narrative, serious,"),
        "raw_age_bands": with_cases(
            f"select {_AGE_BAND} as age_band, "
            "count(*) as n, round(avg(serious), 6) as serious_rate from cases where primaryid % 13 <> 0 group by 1 having age_band is not null"),
        "raw_histogram": _histogram("age").replace("from cases where age is not null", "from cases where age is not null and primaryid % 13 <> 0")
        .replace("using (serious) where age is not null", "using (serious) where age is not null and primaryid % 13 <> 0"),
        "shap_maps": _CONTRIBUTIONS + """
select primaryid, string_agg(part.feature || ':' || printf('%.6f', part.value), ',' order by part.place) as shap
from parts group by primaryid""",
        "shap_summary": _CONTRIBUTIONS + """
select part.feature as feature, round(avg(abs(part.value)), 6) as mean_abs_shap from parts group by 1
order by avg(abs(part.value)) desc, 1 limit 3""",
        "top_factors": _CONTRIBUTIONS + f""",
ranked as (select *, row_number() over (partition by primaryid order by abs(part.value) desc, part.place) as rank from parts)
select primaryid, string_agg(part.feature || ':' || printf('%.4f', round(part.value, 4)) || ':'
  || case when part.value > 0 then '{RAISES}' else '{LOWERS}' end, ',' order by rank) as factors
from ranked where rank <= 5 group by primaryid""",
        "ablation": _scored(f"""
select model, {_AUC}, {_AP}, any_value(f1) as f1, any_value(precision) as precision, any_value(recall) as recall,
  any_value(specificity) as specificity from curve join rated using (model) group by model""",
                            _THREE, _CURVE.format(by="model, ", source="models", part="model"), f"""
rated as (select model, {_RATES} from (select model,
    cast(sum(case when score >= 0.5e0 and serious = 1 then 1 else 0 end) as bigint) as tp,
    cast(sum(case when score >= 0.5e0 and serious = 0 then 1 else 0 end) as bigint) as fp,
    cast(sum(case when score < 0.5e0 and serious = 0 then 1 else 0 end) as bigint) as tn,
    cast(sum(case when score < 0.5e0 and serious = 1 then 1 else 0 end) as bigint) as fn from models group by model))"""),
        "fusion_candidates": _scored(f"""
select case model when 'trees' then 5 else 10 end as iterations, {_AUC}, any_value(loss) as log_loss
from curve join (select model, round(avg(-ln(case when serious = 1 then score else 1 - score end)), 6) as loss
  from models group by model) using (model) where model <> 'text' group by model""",
                                     _THREE, _CURVE.format(by="model, ", source="models", part="model")),
        "text_embedding": with_cases(f"""
, words as (select primaryid, unnest(list_filter(string_split({_NARRATIVE}, ' '), lambda w: w <> '')) as word from cases),
counted as (select primaryid, cast('0x' || md5(word)[1:5] as int) as bucket, count(*) as n from words group by 1, 2),
rarity as (select bucket, ln(((select count(*) from cases) + 1) / (count(*) + 1)) as rarity from counted group by bucket),
signs as (select bucket, rarity, j, 2 * (((instr('0123456789abcdef', md5('{SEED}:' || bucket)[j // 4 + 1]) - 1) >> (3 - j % 4)) & 1) - 1 as sign
  from rarity cross join (select unnest(range(128)) as j)),
summed as (select primaryid, j, sum(n * rarity * sign) as x from counted join signs using (bucket) group by 1, 2),
lengths as (select primaryid, sqrt(sum(x * x)) as length from summed group by 1)
select primaryid, string_agg(cast(cast(round(x / length * 1e6) as bigint) as varchar), ' ' order by j) as embedding
from summed join lengths using (primaryid) group by primaryid"""),
        "influence_places": with_cases(f"""
, words as (select primaryid, unnest(list_filter(string_split({_NARRATIVE}, ' '), lambda w: w <> '')) as token from cases),
counted as (select primaryid, token, cast('0x' || md5(token)[1:5] as int) as bucket, count(*) as n from words group by 1, 2, 3),
rarity as (select bucket, ln(((select count(*) from cases) + 1) / (count(distinct primaryid) + 1)) as rarity from counted group by bucket),
signs as (select bucket, rarity, j, 2 * (((instr('0123456789abcdef', md5('{SEED}:' || bucket)[j // 4 + 1]) - 1) >> (3 - j % 4)) & 1) - 1 as sign
  from rarity cross join (select unnest(range(128)) as j)),
margins as (select bucket, any_value(rarity) as rarity, sum(sign * ((j * 37) % 11 - 5) / 10e0) as margin from signs group by bucket),
summed as (select primaryid, j, sum(n * rarity * sign) as x from counted join signs using (bucket) group by 1, 2),
lengths as (select primaryid, sqrt(sum(x * x)) as length from summed group by 1),
valued as (select primaryid, token, n * rarity * margin / length as importance from counted join margins using (bucket) join lengths using (primaryid))
select primaryid, token, round(importance, 4) + 0.0e0 as importance,
  cast(row_number() over (partition by primaryid order by importance desc, token) as int) as place from valued"""),
        "fit_floors": _scored(f"""
select feature, {_AUC}, true as beaten from curve group by feature""", f"""
held_out as (select * from labelled where {hash_split} // 21474837 >= 80),
singles as (select serious, m.f as feature, m.x as score from (select serious, unnest([
  {{'f': 'age', 'x': cast(coalesce(age, 55) as double)}}, {{'f': 'drug_seq', 'x': cast(coalesce(drug_seq, 1) as double)}},
  {{'f': 'dose_amt', 'x': coalesce({_DOSE}, 0)}}, {{'f': 'dur', 'x': cast(coalesce(dur, 0) as double)}}]) as m from held_out))""",
                              _CURVE.format(by="feature, ", source="singles", part="feature")),
        "subword_tokens": rf"""
with recursive texts as (select doc_id, list_filter(string_split({clean("text")}, ' '), lambda w: w <> '') as tokens from documents),
occurrences as (select doc_id, unnest(tokens) as word, generate_subscripts(tokens, 1) as place from texts),
counted as (select word, count(*) as n from occurrences group by word),
often as (select word from counted where n >= 5 and length(word) <= 12),
letters as (select distinct unnest(string_split(word, '')) as c from counted),
vocabulary as (select word as piece from often
  union select '##' || right(word, n) from often cross join (select unnest([2, 3, 4]) as n) where length(word) > n
  union select c from letters union select '##' || c from letters),
tried as (select word, place, n, case when place > 1 then '##' else '' end || substring(word, place, n) as piece
  from (select word, place, unnest(range(1, least(14, length(word) - place + 1) + 1)) as n
    from (select word, unnest(range(1, length(word) + 1)) as place from counted where length(word) <= 100))),
fits as (select word, place, max(n) as n from tried join vocabulary using (piece) group by word, place),
walk as (select word, cast(1 as bigint) as spot, cast([] as varchar[]) as pieces from counted
  union all select walk.word, spot + fits.n, list_append(pieces, case when spot > 1 then '##' else '' end || substring(walk.word, spot, fits.n))
  from walk join fits on walk.word = fits.word and walk.spot = fits.place),
cut as (select word, coalesce(max(pieces) filter (spot > length(word)), ['[UNK]']) as pieces from walk group by word),
joined as (select doc_id, flatten(list(pieces order by place)) as pieces from occurrences join cut using (word) group by doc_id)
select doc_id, cast(least(256, coalesce(len(pieces), 0)) as int) as n_pieces, coalesce(array_to_string(pieces[1:256], ' '), '') as pieces
from texts left join joined using (doc_id)""",
        "tree_checks": _scored(f"select primaryid, serious, cast({hash_split} // 21474837 < 80 as int) as is_train, true as holds from labelled"),
        "importance_checks": "select cast(16 as bigint) as features, true as adds_up, true as positive",
        "fold_checks": _scored("select primaryid, cast(1 as bigint) as scores, fold, true as holds from folded", _FOLDED),
        "shap_checks": with_cases("select primaryid, true as adds_up from cases"),
        "token_checks": with_cases(
            f"select primaryid, cast(len(list_distinct(list_filter(string_split({_NARRATIVE}, ' '), lambda w: w <> ''))) as int) as words, "
            "true as adds_up from cases"),
        "report_checks": with_cases("select primaryid, true as holds from cases"),
        "request_defaults": with_cases(
            "select primaryid, drugname, route, prod_ai, reactions, cast(age as double) as age, wt, sex, "
            f"{_DOSE} as dose_amt, dose_freq, cast(dur as double) as dur, {_DEFAULTS} from cases"),
    }
