"""The registered queries in SQL, from shared table expressions; each names what it needs."""

from __future__ import annotations

CTE: dict[str, tuple[str, str]] = {
    "req": ("", """select event_id, 'svc-' || lpad((user_id % 10)::varchar, 2, '0') as service, case when ts >= timestamp '2024-01-24' then 'live' else 'baseline' end as win, ts, event_type,
        case when ts >= timestamp '2024-01-24' and user_id % 10 < 3 then value * 4 else value end as latency_ms, event_type = 'error' as is_error, case when event_type = 'error' then '500' else '200' end as code, props, value as raw_value
        from events"""),
    "hourly": ("req", "select service, win, date_trunc('hour', ts) as hour, count(*) as n from req group by all"),
    "rates": ("hourly", """select k.service, k.win, g.hour, coalesce(h.n, 0) / 3600 as rps from (select distinct service, win from hourly) k
        join (select win, unnest(generate_series(min(hour), max(hour), interval 1 hour)) as hour from hourly group by win) g on g.win = k.win
        left join hourly h on h.service = k.service and h.win = k.win and h.hour = g.hour"""),
    "counters": ("req", "select event_id, service, code, ts, ((row_number() over (partition by service, code order by ts, event_id) - 1) % 97 + 1)::double as value from req"),
    "deltas": ("counters", """select *, case when prev is null then 0.0 when value < prev then value else value - prev end as delta
        from (select *, lag(value) over (partition by service, code order by ts, event_id) as prev from counters)"""),
    "bounds": ("", "select unnest([5.0::double, 10, 25, 50, 100, 250, 500, 'inf'::double]) as le"),
    "hist": ("req bounds", "select service, win, le, count(*) filter (latency_ms <= le) as cum from req cross join bounds group by all"),
    "buckets": ("hist", """select *, lag(cum, 1, 0) over (partition by service, win order by le) as pc, lag(le, 1, 0) over (partition by service, win order by le) as pb,
        max(cum) over (partition by service, win) as total from hist"""),
    "latency": ("buckets req", """select b.*, s.stddev_ms from (select service, win, """ + ", ".join(
        f"coalesce(min_by(case when le < 'inf' and cum >= {q} * total then pb + case when cum <= pc then 0.0 else ({q} * total - pc) / (cum - pc) end * (le - pb) end, case when le < 'inf' and cum >= {q} * total then le end) filter (le < 'inf' and cum >= {q} * total), max(le) filter (le < 'inf'), 0.0) as {n}"
        for n, q in (("p50_ms", 0.5), ("p90_ms", 0.9), ("p95_ms", 0.95), ("p99_ms", 0.99))) + """, max(total) as sample_count from buckets group by service, win) b
        join (select service, win, sqrt(sum((cum - pc) * (mid - mean) * (mid - mean)) / max(total)) as stddev_ms from (
            select bk.*, case when le < 'inf' then (pb + le) / 2 when pb = 0 then 1.0 else 2 * pb end as mid, m.s / bk.total as mean
            from buckets bk join (select service, win, sum(latency_ms) as s from req group by all) m using (service, win)) group by service, win) s using (service, win)"""),
    "errs": ("req", """select *, sqrt(error_ratio * (1 - error_ratio) / total_count) as error_stddev, 1 - error_ratio as availability
        from (select service, win, count(*) as total_count, count(*) filter (is_error) as error_count, (count(*) filter (is_error)) / count(*) as error_ratio from req group by all)"""),
    "thr": ("rates", "select service, win, avg(rps) as mean_rps, stddev_pop(rps) as stddev_rps, count(rps) as rate_samples, quantile_disc(rps, 0.95) as p95_rps from rates group by all"),
    "gauges": ("", """select 'svc-' || lpad((l_suppkey % 10)::varchar, 2, '0') as service, case when l_shipdate >= timestamp '1997-01-01' then 'live' else 'baseline' end as win, l_quantity / 50 as cpu, l_discount * 10 as mem from lineitem"""),
    "sat": ("gauges", """select service, win, avg(cpu) as cpu_mean_ratio, avg(mem) as memory_mean_ratio, count(cpu) > 0 or count(mem) > 0 as saturation_available, quantile_disc(cpu, 0.95) as cpu_p95_ratio, quantile_disc(mem, 0.95) as memory_p95_ratio from gauges group by all"""),
    "spans": ("", """select r.root as service_key, case when l_shipdate >= timestamp '1997-01-01' then 'live' else 'baseline' end as win, l_orderkey as trace_id, r.root as root_service,
        'svc-' || lpad((l_suppkey % 10)::varchar, 2, '0') as service, round(l_extendedprice * 1000)::bigint as duration_ns
        from lineitem join (select l_orderkey, 'svc-' || lpad((min_by(l_suppkey, (l_linenumber, l_suppkey)) % 10)::varchar, 2, '0') as root from lineitem group by l_orderkey) r using (l_orderkey)"""),
    "own": ("spans", """select service_key, win, max(v) filter (rn = floor(0.99 * (n - 1)) + 1) as service_p99_ms, max(v) filter (rn = floor(0.5 * (n - 1)) + 1) as service_p50_ms, max(n) as own_spans from (
        select service_key, win, duration_ns / 1e6 as v, row_number() over (partition by service_key, win order by duration_ns) as rn, count(*) over (partition by service_key, win) as n from spans where service = root_service) group by all"""),
    "deps": ("spans", """select service_key, win, dependency, max(v) filter (rn = floor(0.99 * (n - 1)) + 1) as p99_ms, max(n) as call_count from (
        select service_key, win, service as dependency, duration_ns / 1e6 as v, row_number() over (partition by service_key, win, service order by duration_ns) as rn, count(*) over (partition by service_key, win, service) as n
        from spans where service <> root_service) group by all"""),
    "turns": ("deps", "select *, row_number() over (partition by service_key, win order by p99_ms desc, dependency) as turn from deps"),
    "trace": ("turns own", """select t.service_key, t.win, t.dependency as top_dependency, t.p99_ms as top_dependency_p99_ms, o.service_p99_ms, coalesce(t.p99_ms / nullif(o.service_p99_ms, 0), 0.0) as top_dependency_contribution
        from turns t left join own o using (service_key, win) where turn = 1"""),
    "logs": ("", """select 'svc-' || lpad((doc_id % 10)::varchar, 2, '0') as service, case when doc_id % 4 = 3 then 'live' else 'baseline' end as win, case when source = 'src3' then '' else source end as error_type
        from documents join (select doc_id from labels where toxic = 1) using (doc_id)"""),
    "cats": ("logs", "select service, win, coalesce(nullif(error_type, ''), 'unknown') as category, count(*) as n, count(*) / sum(count(*)) over (partition by service, win) as ratio from logs group by service, win, category"),
    "breakdown": ("cats", "select service, win, arg_max(category, (ratio, -ord)) as top_category, max(ratio) as top_category_ratio, count(*) as categories from (select *, rank() over (partition by service, win order by category) as ord from cats) group by all"),
    "base": ("latency errs thr sat trace breakdown", """select l.*, e.* exclude (service, win), t.* exclude (service, win), s.* exclude (service, win, saturation_available), coalesce(s.saturation_available, false) as saturation_available,
        tr.* exclude (service_key, win), b.* exclude (service, win), tr.top_dependency is not null as trace_available, b.top_category is not null as breakdown_available
        from latency l left join errs e using (service, win) left join thr t using (service, win) left join sat s using (service, win)
        left join trace tr on tr.service_key = l.service and tr.win = l.win left join breakdown b on b.service = l.service and b.win = l.win"""),
    "ind": ("base", """select service, win, unnest([
        {'ord': 1, 'name': 'latency_p99_ms', 'value': p99_ms, 'sd': stddev_ms, 'unit': 'ms', 'ok': p99_ms is not null, 'core': true},
        {'ord': 2, 'name': 'latency_p50_ms', 'value': p50_ms, 'sd': stddev_ms, 'unit': 'ms', 'ok': p50_ms is not null, 'core': true},
        {'ord': 3, 'name': 'error_rate_ratio', 'value': error_ratio, 'sd': error_stddev, 'unit': 'ratio', 'ok': error_ratio is not null, 'core': true},
        {'ord': 4, 'name': 'availability_ratio', 'value': availability, 'sd': error_stddev, 'unit': 'ratio', 'ok': availability is not null, 'core': true},
        {'ord': 5, 'name': 'throughput_mean_rps', 'value': mean_rps, 'sd': stddev_rps, 'unit': 'rps', 'ok': mean_rps is not null, 'core': true},
        {'ord': 6, 'name': 'cpu_mean_ratio', 'value': cpu_mean_ratio, 'sd': 0.1::double, 'unit': 'ratio', 'ok': saturation_available, 'core': false},
        {'ord': 7, 'name': 'memory_mean_ratio', 'value': memory_mean_ratio, 'sd': 0.1::double, 'unit': 'ratio', 'ok': saturation_available, 'core': false},
        {'ord': 8, 'name': 'dependency_p99_ms', 'value': top_dependency_p99_ms, 'sd': case when top_dependency_p99_ms > 0 then top_dependency_p99_ms * 0.2 else 10.0 end, 'unit': 'ms', 'ok': trace_available, 'core': false},
        {'ord': 9, 'name': 'error_top_category_ratio', 'value': top_category_ratio, 'sd': case when top_category_ratio > 0 then top_category_ratio * 0.1 else 0.05 end, 'unit': 'ratio', 'ok': breakdown_available, 'core': false}], recursive := true) from base"""),
    "pairs": ("ind", """select b.service, b.ord, b.name, l.value as live_value, b.value as baseline_value, b.sd, case b.unit when 'ratio' then 0.001 when 'ms' then 1.0 else 0.01 end as eps, coalesce(b.ok and l.ok, false) as measured, b.core
        from (from ind where win = 'baseline') b left join (from ind where win = 'live') l using (service, ord) where coalesce(b.ok and l.ok, false) or b.core or (b.ok and b.name in ('cpu_mean_ratio', 'memory_mean_ratio'))"""),
    "dev": ("pairs", """select *, abs(live_value - baseline_value) as abs_deviation, (live_value - baseline_value) / greatest(abs(baseline_value), eps) as rel_deviation,
        case when abs(live_value - baseline_value) < eps * 0.01 then 'stable' when live_value > baseline_value then 'increasing' else 'decreasing' end as direction, baseline_value + 2.0 * sd as band_upper, baseline_value - 2.0 * sd as band_lower from pairs"""),
    "drift": ("dev", """select service, ord, name, case when measured then live_value else 0.0 end as live_value, coalesce(baseline_value, 0.0) as baseline_value, case when measured then abs_deviation else 0.0 end as abs_deviation, case when measured then rel_deviation else 0.0 end as rel_deviation,
        case when measured then direction else 'stable' end as direction, case when measured then band_upper else 0.0 end as band_upper, case when measured then band_lower else 0.0 end as band_lower, measured and breach as band_breach,
        case when not measured then 0.0 when half > 0 then case when breach then abs_deviation / half else 0.0 end when abs_deviation > 0 then 'inf'::double else 0.0 end as breach_magnitude,
        case when not (measured and breach) then 'no_significant_drift' when name like '%dependency%' then case when direction = 'increasing' then 'dependency_latency_regression' else 'no_significant_drift' end when name like '%category%' then 'error_category_shift'
            when name like '%latency%' then case when direction = 'increasing' then 'latency_regression' else 'latency_improvement' end when name like '%error%' then case when direction = 'increasing' then 'error_rate_elevation' else 'error_rate_reduction' end
            when name like '%throughput%' then case when direction = 'decreasing' then 'throughput_collapse' else 'throughput_surge' end when name like '%cpu%' or name like '%memory%' then case when direction = 'increasing' then 'saturation_approach' else 'no_significant_drift' end
            when name like '%availability%' then case when direction = 'decreasing' then 'availability_drop' else 'no_significant_drift' end else 'no_significant_drift' end as first_pass_class,
        case when measured then 'measured' else 'skipped' end as status, case when measured then null when core then 'unmeasured' else 'live_gauges_absent' end as skip_reason
        from (select *, coalesce(live_value > band_upper or live_value < band_lower, false) as breach, (band_upper - band_lower) / 2 as half from dev)"""),
    "ranked": ("drift", "select *, row_number() over (partition by service order by round(breach_magnitude, 9) desc, ord) as place from drift where band_breach"),
    "mapped": ("ranked", "select *, case first_pass_class when 'dependency_latency_regression' then 'latency_regression' when 'error_category_shift' then 'error_rate_elevation' else first_pass_class end as cls from ranked"),
    "signal": ("drift mapped", """select d.service, d.indicators, d.skipped, coalesce(r.name, 'none') as dominant_indicator, coalesce(r.first_pass_class, 'no_significant_drift') as dominant_class, coalesce(r.breach_magnitude, 0.0) as dominant_magnitude, coalesce(a.names, '') as all_breached_indicators,
        case when r.first_pass_class is null then 'no_significant_drift' when r.first_pass_class = 'error_category_shift' and a.classes > 1 then 'distribution_shift' else r.cls end as report_class
        from (select service, count(*) as indicators, count(*) filter (status = 'skipped') as skipped from drift group by all) d left join (from mapped where place = 1) r using (service)
        left join (select service, string_agg(name, ',' order by place) as names, count(distinct cls) filter (cls <> 'no_significant_drift') as classes from mapped group by all) a using (service)"""),
    "report": ("signal", """select *, case when report_class in ('latency_improvement', 'error_rate_reduction', 'no_significant_drift') then 'info' when dominant_magnitude > 10 then 'critical' when dominant_magnitude > 5 then 'high' when dominant_magnitude > 2 then 'medium' when dominant_magnitude > 0 then 'low' else 'info' end as severity,
        case report_class when 'latency_regression' then 'performance' when 'latency_improvement' then 'monitoring' when 'error_rate_elevation' then 'reliability' when 'error_rate_reduction' then 'monitoring' when 'throughput_collapse' then 'capacity' when 'throughput_surge' then 'capacity' when 'saturation_approach' then 'capacity' when 'availability_drop' then 'reliability' when 'distribution_shift' then 'performance' else 'none' end as remediation_category from signal"""),
    "vals": ("drift", "select service, list_distinct(flatten(list([live_value, baseline_value, abs_deviation, rel_deviation, band_upper, band_lower])) || [coalesce(max(breach_magnitude) filter (band_breach), 0.0)]) as vals from drift group by service"),
    "reports": ("report vals", """select *, case when n = 8 then 'critical' else ruled end as severity, case when n = 3 then '' else 'seen in signals' end as cause, case n when 9 then 'kubectl scale' when 2 then 'continue monitoring in 3 steps' else 'continue monitoring' end as action,
        case when n = 6 then 'no figure' else 'latency error capacity at ' || printf('%.4f', case n when 1 then magnitude when 4 then list_max(vals) * 1.5 else list_max(vals) end) || case n when 0 then ' by p99, up 40% in 24h' else '' end end as rationale, case when n <> 5 then 'run again' end as verification
        from (select *, case when cls in ('latency_improvement', 'error_rate_reduction', 'no_significant_drift') then 'info' when magnitude > 10 then 'critical' when magnitude > 5 then 'high' when magnitude > 2 then 'medium' when magnitude > 0 then 'low' else 'info' end as ruled
            from (select service, substr(service, 5, 2)::int as n, report_class as class, dominant_class, dominant_magnitude as magnitude, remediation_category as category, vals, case when substr(service, 5, 2)::int = 7 then 'throughput_surge' else report_class end as cls from report join vals using (service)))"""),
    "cites": ("reports", r"""select *, list_filter(list_transform(regexp_extract_all(bare, '-?[0-9]+\.?[0-9]*'), lambda t: t::double), lambda x: x <> 0) as cited, list_filter(list_transform(regexp_extract_all(rationale, '-?[0-9]+\.?[0-9]*'), lambda t: t::double), lambda x: x <> 0) as figures
        from (select *, regexp_replace(regexp_replace(regexp_replace(cause || ' ' || rationale, '[A-Za-z]-?[0-9]+\.?[0-9]*', ' ', 'g'), '-?[0-9]+\.?[0-9]*[%xX]', ' ', 'g'), '-?[0-9]+\.?[0-9]*[hd]([^A-Za-z]|$)', ' ', 'g') as bare, cause || ' ' || action || ' ' || rationale as told, action || ' ' || rationale as said,
            severity in ('critical', 'high') as grave, cls in ('latency_improvement', 'error_rate_reduction') as calm from reports)"""),
    "judged": ("cites", r"""select service, cls in ('latency_regression', 'latency_improvement', 'error_rate_elevation', 'error_rate_reduction', 'throughput_collapse', 'throughput_surge', 'saturation_approach', 'availability_drop', 'distribution_shift', 'no_significant_drift') and severity in ('critical', 'high', 'medium', 'low', 'info') and cause <> '' and action <> '' and rationale <> '' as schema_valid,
        len(list_filter(cited, lambda c: len(list_filter(vals, lambda x: (x <> 0 and abs(c - x) / greatest(abs(x), 1e-10) < 0.02) or (x = 0 and abs(c) < 1e-10))) = 0)) = 0 as grounding,
        case when dominant_class = 'error_category_shift' and class = 'distribution_shift' then cls = 'distribution_shift' when dominant_class = 'dependency_latency_regression' then cls in ('latency_regression', 'distribution_shift') when dominant_class = 'error_category_shift' then cls = 'error_rate_elevation' when dominant_class = 'latency_regression' then cls in ('latency_regression', 'distribution_shift') else cls = dominant_class end as class_validity,
        not regexp_matches(told, '(?i)\b(?:kubectl|oc|curl|docker|helm)\b|```(?:yaml|yml|json)\b|\b(?:POST|PUT|PATCH|DELETE)\s+https?://') as no_actuation, cls = class as classification_accuracy, severity in ('info', 'low', 'medium', 'high') as severity_calibration,
        case category when 'none' then regexp_matches(action, 'no action|continue monitor|no significant|monitor|baseline|update|track|observe|sustain|verif|confirm')
            when 'performance' then regexp_matches(said, 'latency|performance|profil|optimiz|regression|slow|response time|critical path') when 'monitoring' then regexp_matches(said, 'monitor|baseline|update|track|observe|sustain|verif|confirm')
            when 'reliability' then regexp_matches(said, 'error|reliab|fail|log|rollback|deploy|health|readiness|availab') when 'capacity' then regexp_matches(said, 'capacity|scal|resource|cpu|memory|throughput|load|replica|pod|autoscal') else true end as remediation_relevance,
        len(list_filter(figures, lambda c: len(list_filter(vals, lambda x: x <> 0 and abs(c - x) / greatest(abs(x), 1e-10) < 0.02)) > 0)) > 0 as rationale_quality, coalesce(verification, '') <> '' or calm or cls = 'no_significant_drift' as remediation_depth, not (magnitude = 0 and grave) and not (magnitude > 2 and severity = 'info') and not (calm and grave) as severity_consistent
        from cites"""),
    "grid": ("judged", "select *, schema_valid and grounding and class_validity and no_actuation and classification_accuracy and severity_calibration and remediation_relevance and rationale_quality and remediation_depth and severity_consistent as pass from judged"),
    "seen": ("base", """select service, win, unnest([{'sli_type': 'latency', 'sli_name': 'latency_p99', 'observed': p99_ms, 'sd': stddev_ms, 'target_op': 'lte'}, {'sli_type': 'error_rate', 'sli_name': 'error_rate', 'observed': error_ratio, 'sd': error_stddev, 'target_op': 'lte'},
        {'sli_type': 'availability', 'sli_name': 'availability', 'observed': availability, 'sd': error_stddev, 'target_op': 'gte'}, {'sli_type': 'throughput', 'sli_name': 'throughput', 'observed': mean_rps, 'sd': stddev_rps, 'target_op': 'gte'},
        {'sli_type': 'saturation', 'sli_name': 'cpu', 'observed': cpu_mean_ratio, 'sd': null::double, 'target_op': 'lte'}, {'sli_type': 'saturation', 'sli_name': 'memory', 'observed': memory_mean_ratio, 'sd': null::double, 'target_op': 'lte'}], recursive := true) from base"""),
    "tiers": ("seen", """select *, case n when 0 then 'new' when 1 then 'growing' else 'mature' end as maturity_tier, case n when 0 then 2.0 when 1 then 1.0 else 0.5 end as lo, case n when 0 then 3.0 when 1 then 2.0 else 1.0 end as hi, case when target_op = 'lte' then 1.0 else -1.0 end as sign,
        sli_type = 'availability' and observed = 1.0 as perfect, coalesce(sd > 0, false) as spread from (select *, substr(service, 5, 2)::int % 3 as n from seen where observed <> 0)"""),
    "targets0": ("tiers", """select service, win, sli_type, sli_name, observed, sd, target_op, maturity_tier,
        case when perfect then 0.999 when spread then observed - sign * 0.75 * sd else observed * case when target_op = 'lte' then 0.85 else 1.15 end end as slo_target,
        case when perfect then 0.995 when spread then observed + sign * lo * sd else observed * case when target_op = 'lte' then 1.5 else 0.7 end end as sla_lo, case when perfect then 0.995 when spread then observed + sign * hi * sd else observed * case when target_op = 'lte' then 1.5 else 0.7 end end as sla_hi,
        case when perfect then 0.995 when spread then observed + sign * (lo + hi) / 2 * sd else observed * case when target_op = 'lte' then 1.5 else 0.7 end end as sla_target from tiers"""),
    "targets": ("targets0", "select *, least(greatest(case sli_type when 'availability' then (1 - sla_target) * 100 when 'error_rate' then sla_target * 100 else 0.5 end, 0.0), 100.0) as error_budget_percent from targets0"),
    "prop": ("targets", "select * exclude (win) from targets where win = 'baseline'"),
    "windows": ("", "select * from (values ('1h', '5m', 14.4::double, 'critical'), ('6h', '30m', 6.0::double, 'warning')) w(long_window, short_window, burn_rate, severity)"),
    "rules": ("prop windows", """select service, sli_name, sli_type, sla_target, error_budget_percent, w.*, round(burn_rate * error_budget_percent / 100, 9) as threshold,
        'SLO' || list_aggregate(list_transform(regexp_split_to_array(sli_name, '[-_ ]+'), lambda x: upper(x[1]) || x[2:]), 'string_agg', '') || 'BurnRate' || upper(severity[1]) || severity[2:] as alert, 'armed' as status from prop cross join windows w"""),
    "arts": ("", """select 'svc-' || (o_custkey % 50)::varchar as service, case o_orderstatus when 'F' then 'drift-signal' when 'O' then 'baseline' else 'drift-report' end as artifact_type, o_orderdate as stored_at, o_orderkey, o_orderkey::varchar as payload, o_totalprice > 150000 as breached,
        case when o_totalprice > 300000 then 'latency_improvement' when o_totalprice > 150000 then 'latency_regression' else 'no_significant_drift' end as class, case o_orderkey % 3 when 0 then 'critical' when 1 then 'medium' else 'info' end as severity, case o_orderkey % 2 when 0 then 'new' else 'mature' end as maturity_tier from orders"""),
    "newest": ("arts", "select *, row_number() over (partition by service, artifact_type order by stored_at desc, o_orderkey desc) as turn from arts"),
    "status": ("newest", """select *, case when has_drift_signal then case when not breached then 'healthy' when drift_class in ('latency_improvement', 'error_rate_reduction') then 'improving' when drift_severity in ('critical', 'high') then 'critical' else 'degraded' end when has_baseline then 'baselined' else 'unknown' end as status from (
        select service, bool_or(artifact_type = 'baseline') as has_baseline, false as has_proposal, bool_or(artifact_type = 'drift-signal') as has_drift_signal, bool_or(artifact_type = 'drift-report') as has_drift_report, max(stored_at) filter (artifact_type = 'baseline' and turn = 1) as last_baseline, max(stored_at) filter (artifact_type = 'drift-signal' and turn = 1) as last_drift,
        bool_or(breached) filter (artifact_type = 'drift-signal' and turn = 1) as breached, max(class) filter (artifact_type = 'drift-signal' and turn = 1) as drift_class, max(severity) filter (artifact_type = 'drift-report' and turn = 1) as drift_severity, coalesce(max(maturity_tier) filter (artifact_type = 'baseline' and turn = 1), 'unknown') as maturity_tier from newest group by service)"""),
    "sections": ("", r"""select doc_id, source as section, '{' || chr(10) || '  "id": ' || doc_id || ',' || chr(10) || coalesce('  "lang": "' || lang || '",' || chr(10), '') || '  "ratio": ' || case when contains(r, '.') then r else r || '.0' end || ',' || chr(10)
        || '  "text": {' || chr(10) || '    "n": ' || length(text) || ',' || chr(10) || '    "sha256": "' || sha256(text) || '"' || chr(10) || '  }' || chr(10) || '}' || chr(10) as payload from (select *, printf('%.6g', length(text) / 7) as r from documents)"""),
    "daily": ("", "select 'svc-' || lpad((l_suppkey % 10)::varchar, 2, '0') as service, case when l_shipdate >= timestamp '1997-01-01' then 'live' else 'baseline' end as win, l_shipdate::date as day, avg(l_quantity / 50) as cpu, avg(l_discount * 10) as mem from lineitem group by all"),
    "bundles": ("latency errs thr own turns breakdown daily req", """select l.service, l.win, case when substr(l.service, 5, 2)::int % 2 = 0 then 'shop' else 'core' end as namespace, '30d' as lookback_window, strftime(q.b, '%Y-%m-%d %H:%M:%S') as generated_at, l.* exclude (service, win), e.* exclude (service, win), t.* exclude (service, win),
        s.* exclude (service, win), s.service is not null as saturation_available, case when d.dependency is not null then coalesce(o.service_p99_ms, 0.0) end as service_p99_ms, d.dependency as top_dependency, d.p99_ms as top_dependency_p99_ms, case when d.dependency is not null then coalesce(d.p99_ms / nullif(o.service_p99_ms, 0), 0.0) end as top_dependency_contribution, d.dependency is not null as trace_available,
        b.top_category, b.top_category_ratio, coalesce(b.categories, 0) as categories, b.top_category is not null as breakdown_available, c.coverage_ratio
        from latency l join errs e using (service, win) join thr t using (service, win) join (select service, win, max(ts) as b from req group by all) q using (service, win)
        join (select service, win, count(*) filter (rps > 0) / count(*) as coverage_ratio from rates group by all) c using (service, win)
        left join (select service, win, avg(cpu) as cpu_mean_ratio, quantile_disc(cpu, 0.95) as cpu_p95_ratio, avg(mem) as memory_mean_ratio, quantile_disc(mem, 0.95) as memory_p95_ratio from daily group by all) s using (service, win)
        left join own o on o.service_key = l.service and o.win = l.win left join turns d on d.service_key = l.service and d.win = l.win and d.turn = 1 left join breakdown b on b.service = l.service and b.win = l.win"""),
    "error_steps": ("req", "select service, epoch(date_trunc('second', ts))::bigint // 300 * 300 as epoch, count(*) filter (is_error) / count(*) as ratio from req group by all"),
    "latency_steps": ("req prop", """select r.service, epoch(date_trunc('second', ts))::bigint // 300 * 300 as epoch, count(*) as n, count(*) filter (latency_ms <= round(sla_target, 4)) as hits from req r join prop p on p.service = r.service and p.sli_type = 'latency' group by all"""),
    "cpu_steps": ("", "select 'svc-' || lpad((l_suppkey % 10)::varchar, 2, '0') as service, epoch(l_shipdate::timestamp)::bigint // 86400 * 86400 as epoch, avg(l_quantity / 50) as cpu from lineitem group by all"),
    "wins": ("req", "select service, is_error, latency_ms, unnest([s, s - interval 12 hour]) as ws from (select *, time_bucket(interval 12 hour, ts) as s from req)"),
}


def sql(needs: str, select: str) -> str:
    """A query over the named table expressions and all that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for n in CTE[name][0].split():
                add(n)
            order.append(name)

    for name in needs.split():
        add(name)
    return ("with " + ",\n".join(f"{n} as ({CTE[n][1]})" for n in order) + "\n" if order else "") + select


def rounded(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) as {c}" for c in columns.split())


_DRIFT = "service, ord, name, " + rounded("live_value baseline_value abs_deviation rel_deviation", 5) + ", direction, " + rounded("band_upper band_lower", 5) + ", band_breach, round(breach_magnitude, 5) as breach_magnitude, first_pass_class, status, skip_reason"
_LAT = rounded("p50_ms p90_ms p95_ms p99_ms stddev_ms", 5)
_SVC = "substr(service, 5, 2)::int"
_GATES = "schema_valid grounding class_validity no_actuation classification_accuracy severity_calibration remediation_relevance rationale_quality remediation_depth severity_consistent pass".split()
_PROPOSAL_GATES = "schema_valid grounding consistency indicator_appropriateness budget_coherence rationale_quality margin_quality direction_validity trace_log_citation pass".split()


def _violations(rows: str) -> str:
    return f"""select service, sli_name, coalesce(list_aggregate(list_filter([case when target_op <> op then 'wrong_op' end, case when judged and not slo_tight then 'slo_not_tighter' end, case when judged and sla_tight then 'sla_tighter' end, case when judged and slo = observed then 'slo_equals_observed' end, case when judged and sla = observed then 'sla_equals_observed' end,
        case when judged and sd > 0 and loose / sd > 5 then 'too_loose' end, case when judged and crossed then 'wrong_order' end], lambda x: x is not null), 'string_agg', ','), '') as violations from (
        select *, not ((op = 'gte' and observed >= 1) or (op = 'lte' and observed <= 0)) as judged, case when op = 'lte' then slo < observed else slo > observed end as slo_tight, case when op = 'lte' then sla < observed else sla > observed end as sla_tight, case when op = 'lte' then sla - observed else observed - sla end as loose,
        case when op = 'lte' then slo >= sla else slo <= sla end as crossed from ({rows}))"""


def _totals(rows: str, gates: list[str]) -> str:
    return " union all ".join(f"select '{g}' as gate, count(*) as documents, count(*) filter ({g}) as passed from {rows}" for g in gates)


def _fired(steps: str, value: str, kind: str, threshold: str, windows: tuple[tuple[str, int, int], ...]) -> str:
    """Steps, firings and peaks of each rule: ``value`` is an aggregate over a frame, ``threshold`` what both windows' values must be beyond."""
    frame = lambda s: value.replace("over", f"over (partition by service order by epoch range between {s - 1} preceding and current row)")
    both = " union all ".join(f"select service, epoch, '{w}' as w, {frame(a)} as l, {frame(b)} as s from {steps}" for w, a, b in windows)
    return f"""select v.service, alert, count(*) as steps, count(*) filter ({threshold.replace('value', 'l')} and {threshold.replace('value', 's')}) as firing, round(max(l), 6) as long_peak, round(max(s), 6) as short_peak
        from ({both}) v join rules r on r.service = v.service and r.long_window = v.w and {kind} group by all"""


#: Targets with a fault by service, as the graded proposals have.
_FAULTY = f"""select service, {_SVC} as n, sli_name, sli_type, observed, sd, error_budget_percent, case when {_SVC} = 5 then 'gte' else target_op end as target_op, target_op as op, case when {_SVC} = 1 then observed else slo_target end as slo, sla_target as sla from prop where sli_type <> 'saturation'"""
_NUMBERS = "p50_ms p90_ms p95_ms p99_ms stddev_ms sample_count error_ratio error_stddev error_count total_count availability mean_rps p95_rps stddev_rps rate_samples cpu_mean_ratio cpu_p95_ratio memory_mean_ratio memory_p95_ratio service_p99_ms top_dependency_p99_ms top_dependency_contribution top_category_ratio categories".split()
CTE["proposal_grades"] = ("prop base", """select *, """ + " and ".join(_PROPOSAL_GATES[:-1]) + """ as pass from (
    select service, bool_and(sli_type in ('latency', 'availability', 'throughput', 'saturation', 'error_rate') and target_op in ('lte', 'gte') and budget between 0 and 100 and rationale <> '') as schema_valid, bool_and(cites) as grounding, bool_and(violations = '') as consistency, bool_and(budget > 0 and budget <= 100) as budget_coherence, bool_and(cites) as rationale_quality,
    bool_and(slo <> observed and sla <> observed) as margin_quality, bool_and(target_op = case when sli_type in ('availability', 'throughput') then 'gte' else 'lte' end) as direction_validity,
    bool_and((sli_type <> 'latency' or dep is null or contains(lower(rationale), lower(dep))) and (sli_type not in ('error_rate', 'availability') or cat is null or contains(lower(rationale), lower(cat)) or contains(lower(rationale), lower(replace(cat, '_', ' '))))) as trace_log_citation,
    bool_or(sli_type = 'latency') and bool_or(sli_type in ('availability', 'error_rate')) as indicator_appropriateness from (
        select *, len(list_filter(regexp_extract_all(rationale, '[0-9]+\\.?[0-9]*'), lambda t: len(list_filter(vals, lambda x: t::double = x or (x <> 0 and abs(t::double - x) / greatest(abs(x), 1e-10) < 0.01))) > 0)) > 0 as cites from (
            select p.service, p.sli_type, p.observed, p.target_op, p.slo, p.sla, v.violations, b.top_dependency as dep, b.top_category as cat, case p.n when 6 then 101.0 when 7 then 0.0 else p.error_budget_percent end as budget, list_filter([""" + ", ".join(f"b.{c}::double" for c in _NUMBERS) + """], lambda x: x is not null) as vals,
                case when p.n = 8 then '' else 'observed ' || case p.n when 3 then 'no figure' when 4 then '123456789.5' else printf('%.6f', p.observed) end || ' with ' || coalesce(b.top_dependency, '') || ' and ' || case p.n when 2 then '' else coalesce(b.top_category, '') end end as rationale
            from (""" + _FAULTY + """) p join base b on b.service = p.service and b.win = 'baseline' join (""" + _violations(_FAULTY) + """) v on v.service = p.service and v.sli_name = p.sli_name)) group by service)""")

_RULE_WINDOWS = (("1h", 3600, 300), ("6h", 21600, 1800))
_CHECKED = f"""select service, sli_name, sli_type, observed, sd, case when {_SVC} = 5 then 'gte' else target_op end as target_op, target_op as op,
  case when {_SVC} = 1 then observed when {_SVC} = 2 then sla_target else slo_target end as slo, case when {_SVC} = 3 then observed + 9 * coalesce(sd, 0) when {_SVC} = 4 then slo_target else sla_target end as sla from prop where sli_type <> 'saturation'"""

ORACLE_SQL: dict[str, str] = {
    "scan_events_window": sql("req", "select event_id, service, round(latency_ms, 6) as latency_ms from req where event_type = 'error' and ts >= timestamp '2024-01-30' - interval 7 day and ts <= timestamp '2024-01-30'"),
    "label_regex_5xx": sql("req", "select service, count(*) as n from req where regexp_full_match(code, '5..') group by service"),
    "name_validity": r"""with r as (select p_partkey, p_name, regexp_replace(regexp_replace(lower(p_name), '[ _]', '-', 'g'), '[^a-z0-9-]', '', 'g') as resource from part)
        select p_partkey, regexp_full_match(p_name, '[a-z0-9]([-a-z0-9]*[a-z0-9])?') and length(p_name) <= 63 as as_is, regexp_full_match(resource, '[a-z0-9]([-a-z0-9]*[a-z0-9])?') and length(resource) <= 63 as as_resource, resource from r""",
    "metric_segment": r"""with n as (select c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(c_name), '[- ]', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_') as s from customer)
        select c_custkey, case when s = '' then 'unnamed' when regexp_matches(s, '^[0-9]') then '_' || s else s end as segment, '_' || c_custkey || '_x_y' as numbered from n""",
    "alert_names": "select o_orderkey, 'SLO' || list_aggregate(list_transform(list_filter(regexp_split_to_array(lower(o_orderpriority), '[-_ ]+'), lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), 'string_agg', '') || 'BurnRateCritical' as alert from orders",
    "duration_parse": """with t as (select o_orderkey, o_custkey % 100 as n, (['s', 'm', 'h', 'd', 'w'])[o_orderkey % 5 + 1] as u from orders), s as (select o_orderkey, n || u as text, n * case u when 's' then 1 when 'm' then 60 when 'h' then 3600 when 'd' then 86400 end as seconds from t)
        select o_orderkey, text, coalesce(seconds, -1) as seconds, case when seconds is null then null when seconds >= 86400 and seconds % 86400 = 0 then seconds // 86400 || 'd' when seconds >= 3600 and seconds % 3600 = 0 then seconds // 3600 || 'h' when seconds >= 60 and seconds % 60 = 0 then seconds // 60 || 'm' else seconds || 's' end as back from s""",
    "metric_discovery": sql("req", """select service, coalesce(max(event_type) filter (event_type = 'view'), min(event_type) filter (event_type in ('view', 'click'))) as latency, coalesce(max(event_type) filter (event_type = 'click'), min(event_type) filter (event_type in ('click', 'signup'))) as requests,
        min(event_type) filter (event_type = 'error') as errors, case when bool_or(event_type in ('view', 'click', 'signup', 'error')) then 'discovered' else 'container-only' end as origin from req group by service"""),
    "contract_violations": """select o_orderkey, list_aggregate(v, 'string_agg', '; ') as violations from (select o_orderkey, list_filter([case when o_orderkey is null then 'o_orderkey: missing' end, case when o_totalprice < 1000 or o_totalprice > 250000 then 'o_totalprice: out of range' end,
        case when o_orderstatus not in ('F', 'O') then 'o_orderstatus: not allowed' end, case when not regexp_matches(o_orderpriority, '^[1-4]-') then 'o_orderpriority: malformed' end], lambda x: x is not null) as v from orders) where len(v) > 0""",
    "supported_versions": "select count(*) as n, case when l_linenumber in (1, 2) then 'supported' else 'aside' end as kind from lineitem group by kind",
    "canonical_round": "select l_orderkey, l_linenumber, printf('%.5e', sqrt(l_extendedprice))::double as value from lineitem",
    "json_props": sql("req", "select json_extract(props, '$.k')::int as k, count(*) as n from req group by 1"),
    "instant_latest": sql("req", "select service, code, round(arg_max(latency_ms, (ts, event_id)), 6) as value from req where ts <= timestamp '2024-01-20 12:00:00' group by all"),
    "step_grid_asof": sql("req", """, grid as (select service, unnest(generate_series(timestamp '2024-01-10', timestamp '2024-01-12', interval 5184 second)) as ts from (select distinct service from req))
        , last as (select service, ts, arg_max(latency_ms, event_id) as v from req group by all)
        select g.service, g.ts, case when g.ts - l.ts <= interval 3600 second then round(l.v, 6) end as value from grid g asof left join last l on l.service = g.service and l.ts <= g.ts""").replace("\n, grid as", ",\ngrid as", 1),
    "coverage": sql("req", "select service, round(least(count(*) filter (event_type in ('view', 'click', 'error')) / (30 * 86400 / 5184.0 * 3), 1.0), 6) as coverage, round(count(distinct epoch(ts)::bigint // 5184) / (30 * 86400 / 5184.0), 6) as step_coverage from req group by service"),
    "counter_total": sql("counters", "select service, sum(v) as total from (select service, code, arg_max(value, (ts, event_id)) as v from counters group by all) group by service"),
    "counter_increase": sql("deltas", "select service, code, sum(delta) as increase from deltas group by all"),
    "counter_rate": sql("deltas", "select event_id, service, code, round(sum(delta) over (partition by service, code order by epoch(ts)::bigint range between 21600 preceding and current row) / 21600, 9) as rate from (select * replace (date_trunc('second', ts) as ts) from deltas)"),
    "rate_by_service": sql("deltas", "select service, epoch(ts)::bigint // 3600 * 3600 as epoch, round(sum(delta) / 3600, 9) as rps from (select * replace (date_trunc('second', ts) as ts) from deltas) group by all"),
    "avg_by": sql("req", "select service, epoch(date_trunc('day', ts))::bigint as epoch, round(avg(latency_ms), 6) as mean from req group by all"),
    "avg_over_time": sql("req", "select event_id, round(avg(latency_ms) over (partition by service order by epoch(date_trunc('second', ts))::bigint range between 86399 preceding and current row), 9) as mean from req"),
    "error_ratio_series": sql("req", "select service, epoch(date_trunc('second', ts))::bigint // 21600 * 21600 as epoch, count(*) as n, count(*) filter (is_error) as hits, round(count(*) filter (is_error) / count(*), 6) as ratio from req group by all"),
    "quantile_over_time": sql("req bounds", """, h as (select service, strftime(ts, '%Y-%m-%d') as day, le, count(*) filter (latency_ms <= le) as cum from req cross join bounds group by all),
        b as (select *, lag(cum, 1, 0) over w as pc, lag(le, 1, 0) over w as pb, max(cum) over (partition by service, day) as total from h window w as (partition by service, day order by le))
        select service, day, """ + ", ".join(f"round(coalesce(min_by(pb + case when cum <= pc then 0.0 else ({q} * total - pc) / (cum - pc) end * (le - pb), le) filter (le < 'inf' and cum >= {q} * total), max(le) filter (le < 'inf'), 0.0), 6) as {n}" for n, q in (("p99_ms", 0.99), ("p50_ms", 0.5))) + ", max(total) as sample_count from b group by service, day").replace("\n, h as", ",\nh as", 1),
    "bucketize": sql("hist", "select * from hist"),
    "hist_assemble": sql("hist", "select service, le, sum(cum)::double as cum from hist group by all"),
    "latency_indicator": sql("latency", f"select service, win, {_LAT}, sample_count from latency"),
    "error_availability": sql("errs", f"select service, win, total_count, error_count, {rounded('error_ratio error_stddev availability', 9)} from errs"),
    "throughput": sql("thr", f"select service, win, {rounded('mean_rps stddev_rps p95_rps', 9)}, rate_samples from thr"),
    "saturation": sql("sat", f"select service, win, saturation_available, {rounded('cpu_mean_ratio memory_mean_ratio cpu_p95_ratio memory_p95_ratio')} from sat"),
    "span_counts": sql("spans", "select service_key, win, count(*) as total_spans, count(*) filter (service = root_service) as service_spans from spans group by all"),
    "service_latency": sql("own", f"select service_key, win, {rounded('service_p99_ms service_p50_ms')}, own_spans from own"),
    "trace_fallback": sql("own spans", f"""select service_key, win, {rounded('service_p99_ms service_p50_ms')}, own_spans from (select * from own where service_key <> 'svc-03' union all
        select service_key, win, max(v) filter (rn = floor(0.99 * (n - 1)) + 1), max(v) filter (rn = floor(0.5 * (n - 1)) + 1), max(n) from (select service_key, win, v, row_number() over (partition by service_key, win order by v) as rn, count(*) over (partition by service_key, win) as n from (
        select service_key, win, trace_id, floor(max(duration_ns) / 1e6) as v from spans where service_key = 'svc-03' and service <> root_service group by all)) group by all)"""),
    "dependencies_top5": sql("turns", "select service_key, win, dependency, round(p99_ms, 6) as p99_ms, call_count, turn from turns where turn <= 5"),
    "trace_latency": sql("trace", f"select service_key, win, top_dependency, {rounded('top_dependency_p99_ms service_p99_ms top_dependency_contribution')}, printf('%s accounts for %.0f%% of p99 tail latency', top_dependency, round(top_dependency_contribution, 2) * 100) as slow_span_pattern from trace"),
    "log_categories": sql("cats", "select service, win, category, n, round(ratio, 6) as ratio from cats"),
    "category_map": sql("cats", "select service, win, string_agg(category || '=' || printf('%.4f', ratio), ',' order by category) as rates from cats group by all"),
    "error_breakdown": sql("breakdown", "select service, win, top_category, round(top_category_ratio, 6) as top_category_ratio, categories from breakdown"),
    "baseline": sql("base", f"""select service, win, {_LAT}, sample_count, total_count, error_count, {rounded('error_ratio error_stddev availability mean_rps stddev_rps p95_rps cpu_mean_ratio memory_mean_ratio cpu_p95_ratio memory_p95_ratio', 5)}, rate_samples, saturation_available,
        top_dependency, {rounded('top_dependency_p99_ms service_p99_ms top_dependency_contribution', 5)}, top_category, round(top_category_ratio, 5) as top_category_ratio, coalesce(categories, 0) as categories, trace_available, breakdown_available, '30d' as lookback_window from base"""),
    "evidence_baseline": sql("bundles", f"""select service, win, namespace, lookback_window, generated_at, {rounded('p50_ms p90_ms p95_ms p99_ms stddev_ms', 7)}, sample_count, total_count, error_count, {rounded('error_ratio error_stddev availability mean_rps stddev_rps p95_rps cpu_mean_ratio memory_mean_ratio cpu_p95_ratio memory_p95_ratio coverage_ratio', 7)}, rate_samples, saturation_available,
        top_dependency, {rounded('top_dependency_p99_ms service_p99_ms top_dependency_contribution top_category_ratio', 7)}, top_category, categories, trace_available, breakdown_available from bundles"""),
    "evidence_violations": sql("bundles cats", f"""select service, win, case {_SVC} when 1 then 'coverage_ratio' when 2 then 'series.latency_histogram.buckets[3].count' when 3 then 'namespace' when 4 then 'lookback_window' when 5 then 'series.error_total' when 7 then 'schema_version' when 9 then 'series.latency_histogram.buckets[7].le' end as path,
        case {_SVC} when 1 then 'above' when 2 then 'below' when 3 then 'too short' when 4 then 'malformed' when 5 then 'missing' when 7 then 'above' when 9 then 'malformed' end as rule from bundles where {_SVC} in (1, 2, 3, 4, 5, 7, 9)
        union all select service, win, 'series.logs.error_breakdown[' || (row_number() over (partition by service, win order by ratio desc, category) - 1) || '].ratio' as path, 'above' as rule from cats where {_SVC} = 8 and ratio * 3 > 1 and exists (select 1 from bundles b where b.service = cats.service and b.win = cats.win)"""),
    "baseline_documents": sql("bundles", "select service, win, (coalesce(top_dependency_contribution, 0) > 1)::int + (coalesce(cpu_mean_ratio, 0) > 1)::int + (coalesce(memory_mean_ratio, 0) > 1)::int + (coalesce(cpu_p95_ratio, 0) > 1)::int + (coalesce(memory_p95_ratio, 0) > 1)::int as violations from bundles"),
    "canonical_quarantine": r"""with r as (select l_linenumber, printf('%.6g', l_discount) as a, printf('%.6g', sqrt(l_extendedprice)) as b from lineitem),
        t as (select l_linenumber, '{' || chr(10) || '  "l_linenumber": ' || l_linenumber || ',' || chr(10) || '  "parts": [' || chr(10) || '    {' || chr(10) || '      "root": ' || case when contains(b, '.') then b else b || '.0' end || ',' || chr(10) || '      "share": ' || case when contains(a, '.') then a else a || '.0' end || chr(10) || '    }' || chr(10) || '  ]' || chr(10) || '}' || chr(10) as payload from r)
        select l_linenumber, count(*) as n, case when l_linenumber in (3, 5) then 0 else sum(('0x' || md5(payload)[:6])::bigint) end::bigint as digest, case when l_linenumber in (3, 5) then 'aside' else 'kept' end as kind from t group by l_linenumber""",
    "drift_core": sql("drift", f"select {_DRIFT} from drift where ord <= 5"),
    "drift_saturation": sql("drift", f"select {_DRIFT} from drift where ord in (6, 7)"),
    "drift_dependency": sql("drift", f"select {_DRIFT} from drift where ord = 8"),
    "drift_category": sql("drift", f"select {_DRIFT} from drift where ord = 9"),
    "drift_skipped": sql("ind", """select service, name, 0.0::double as live_value, false as band_breach, 'no_significant_drift' as first_pass_class, case when core then 'unmeasured' else 'live_gauges_absent' end as skip_reason
        from ind where win = 'baseline' and ((service in ('svc-04', 'svc-05') and ord <= 7) or (service = 'svc-06' and ord in (6, 7))) and (core or ok)"""),
    "drift_signal": sql("signal", "select service, indicators, skipped, dominant_indicator, dominant_class, round(dominant_magnitude, 5) as dominant_magnitude, all_breached_indicators from signal"),
    "report_class": sql("report", "select service, report_class, severity, remediation_category from report"),
    "patterns": sql("drift", """select service, u99 and not b50 as tail_only, u99 and dt as capacity_saturation, u99 and ue as upstream_failure, ud and not b50 as dependency_isolated from (select service, bool_or(ord = 1 and band_breach and direction = 'increasing') as u99, bool_or(ord = 2 and band_breach) as b50,
        bool_or(ord = 5 and band_breach and direction = 'decreasing') as dt, bool_or(ord = 3 and band_breach and direction = 'increasing') as ue, bool_or(ord = 8 and band_breach and direction = 'increasing') as ud from drift group by service)"""),
    "target_rows": sql("prop", f"select service, sli_type, sli_name, {rounded('observed', 5)}, round(coalesce(sd, -1.0), 5) as sd, target_op, maturity_tier, {rounded('slo_target sla_lo sla_hi sla_target error_budget_percent', 5)} from prop"),
    "promotion": sql("signal targets", "select s.service, s.dominant_class, t.sli_type, round(t.slo_target, 5) as slo_target from signal s join targets t on t.service = s.service and t.win = 'live' and t.sli_type in ('latency', 'error_rate') where s.dominant_class in ('latency_improvement', 'error_rate_reduction', 'no_significant_drift')"),
    "target_violations": sql("prop", _violations(_CHECKED)),
    "margin_direction": sql("prop", f"select service, bool_and({_SVC} <> 1 and slo_target <> observed and sla_target <> observed) as margin_ok, bool_and({_SVC} <> 5 or target_op = 'gte') as direction_ok from prop group by service"),
    "grading_grid": sql("grid", f"select service, {', '.join(_GATES)} from grid"),
    "grading_totals": sql("grid", _totals("grid", _GATES)),
    "proposal_grid": sql("proposal_grades", f"select service, {', '.join(_PROPOSAL_GATES)} from proposal_grades"),
    "proposal_totals": sql("proposal_grades", _totals("proposal_grades", _PROPOSAL_GATES)),
    "error_alerts": sql("error_steps rules", _fired("error_steps", "avg(ratio) over", "r.sli_type = 'error_rate'", "value > round(threshold, 6)", _RULE_WINDOWS)),
    "availability_alerts": sql("error_steps rules", _fired("error_steps", "avg(ratio) over", "r.sli_type = 'availability'", "value > round(threshold, 6)", _RULE_WINDOWS)),
    "throughput_rule_alerts": sql("req rules", """, st as (select service, epoch(date_trunc('second', ts))::bigint // 300 * 300 as epoch, count(*) as n from req group by all),
        v as (""" + " union all ".join(f"select service, epoch, '{w}' as w, sum(n) over (partition by service order by epoch range between {a - 1} preceding and current row) / {a} as l, sum(n) over (partition by service order by epoch range between {b - 1} preceding and current row) / {b} as s from st" for w, a, b in _RULE_WINDOWS) + """),
        x as (select v.service, alert, l, s, round(sla_target, 9) * (1 - burn_rate * error_budget_percent / 100) as least from v join rules r on r.service = v.service and r.long_window = v.w and r.sli_type = 'throughput')
        select service, alert, count(*) as steps, count(*) filter (l < least and s < least) as firing, round(max(l), 6) as long_peak, round(max(s), 6) as short_peak from x group by all"""),
    "target_headroom": sql("tiers prop", """select p.service, p.sli_name, round(p.observed, 7) as observed_value, round(abs(p.sla_target - p.observed), 7) as margin, case when t.perfect then 'practical default' when t.spread then 'standard deviations' else 'share of observed' end as margin_rationale
        from prop p join tiers t on t.service = p.service and t.win = 'baseline' and t.sli_name = p.sli_name"""),
    "payload_spans": sql("spans", "select root_service, service, sum(n)::bigint as spans, count(*) as traces, sum(total)::bigint as duration_ns, sum(n * ms)::bigint as trace_ms from (select root_service, service, trace_id, count(*) as n, sum(duration_ns) as total from spans group by all) join (select trace_id, floor(max(duration_ns) / 1e6)::bigint as ms from spans group by all) using (trace_id) group by all"),
    "payload_logs": sql("logs", "select service, error_type, count(*) as lines, sum(length(error_type) + 14)::bigint as chars from logs group by all"),
    "payload_samples": sql("req", "select service, code, count(*) as n, round(sum(round(latency_ms, 3)), 3) as total, min(epoch(date_trunc('second', ts))::bigint) as first, max(epoch(date_trunc('second', ts))::bigint) as last from req group by all"),
    "payload_evidence": sql("bundles", f"select service || '/' || substr(generated_at, 9, 2) as service, namespace, {rounded('p50_ms p99_ms stddev_ms error_ratio mean_rps p95_rps cpu_mean_ratio', 6)}, top_dependency, top_category, sample_count from bundles"),
    "span_rows": sql("spans", "select service_key, win, service, count(*) as calls, count(distinct trace_id) as traces, round(max(duration_ns) / 1e6, 6) as longest_ms from spans group by all"),
    "log_lines": sql("logs", "select service, win, coalesce(nullif(error_type, ''), 'unknown') as category, count(*) as lines from logs group by all"),
    "baseline_provenance": sql("req", """, found as (select service, win, count(*) as source_rows, min(ts) as a, max(ts) as b, count(distinct date_trunc('hour', ts)) as steps from req group by all),
        ends as (select win, date_diff('hour', date_trunc('hour', min(ts)), date_trunc('hour', max(ts))) + 1 as hours from req group by all),
        expected as (select distinct 'svc-' || lpad((c_custkey % 12)::varchar, 2, '0') as service, unnest(['baseline', 'live']) as win from customer)
        select e.service, e.win, coalesce(source_rows, 0) as source_rows, strftime(a, '%Y-%m-%d %H:%M:%S') as first_ts, strftime(b, '%Y-%m-%d %H:%M:%S') as last_ts, round(steps / hours, 7) as coverage_ratio, case when f.service is not null then 'events' end as source,
            case when source_rows is null then 'no_data' when date_diff('day', b, timestamp '2024-04-25') > 90 then 'stale' else 'ok' end as status, case when coalesce(steps / hours, 0) < 0.5 then 'fail' when steps / hours < 0.9 then 'warn' else 'ok' end as coverage_status,
            case when steps / hours >= 0.5 and steps / hours < 0.9 then 1.5 else 1.0 end as band_multiplier, date_diff('day', b::date, date '2024-04-25')::int as baseline_age_days
        from expected e left join found f using (service, win) left join ends using (win)"""),
    "latency_alerts": sql("latency_steps rules", _fired("latency_steps", "sum(hits) over / sum(n) over", "r.sli_type = 'latency'", "1 - value > threshold", _RULE_WINDOWS)),
    "record_cpu": sql("cpu_steps", "select service, epoch, round(cpu, 6) as cpu from cpu_steps"),
    "saturation_alerts": sql("cpu_steps rules", _fired("cpu_steps", "avg(cpu) over", "r.sli_name = 'cpu'", "value > round(sla_target, 6) + burn_rate * error_budget_percent / 100", (("1h", 604800, 86400), ("6h", 604800, 86400)))),
    "drift_counts": sql("status", "select coalesce(drift_class, '') <> 'no_significant_drift' as drifting, coalesce(drift_severity, 'info') as severity, count(*) as services from status where has_drift_signal group by all"),
    "burn_windows": sql("rules", "select service, sli_name, alert, severity, long_window, short_window, burn_rate, round(threshold, 7) as threshold, status from rules"),
    "alert_summary": sql("rules", "select count(*) as alerts, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'warning') as warning, count(distinct service) as services from rules"),
    "objectives": sql("prop", "select service, sli_name, sli_type, target_op, round(case when sli_type = 'latency' then (100 - error_budget_percent) / 100 else slo_target end, 5) as target, round(case when sli_type = 'latency' then slo_target else -1.0 end, 5) as value from prop"),
    "alert_policies": sql("prop windows", "select service, sli_name, severity, burn_rate as threshold, long_window as lookback, short_window as alert_after from prop cross join windows"),
    "budget_status": sql("prop drift", "select p.service, p.sli_name, p.sli_type, case when exists (select 1 from drift d where d.service = p.service and d.band_breach and contains(d.name, p.sli_type)) then 'burning' else 'healthy' end as budget_status from prop p"),
    "record_latency": sql("prop req", "select r.service, epoch(date_trunc('day', ts))::bigint as epoch, round(count(*) filter (latency_ms <= round(sla_target, 4)) / count(*), 6) as good_ratio from req r join prop p on p.service = r.service and p.sli_type = 'latency' group by all"),
    "alerts_fired": sql("req rules", """, steps as (select service, epoch(date_trunc('hour', ts))::bigint as epoch, count(*) filter (is_error) / count(*) as ratio from req group by all),
        w as (select *, avg(ratio) over (partition by service order by epoch range between 21599 preceding and current row) as l, avg(ratio) over (partition by service order by epoch range between 3599 preceding and current row) as s from steps)
        select w.service, alert, epoch, round(l, 6) as long_value, round(s, 6) as short_value, l > round(threshold, 5) / 20 and s > round(threshold, 5) / 20 as firing from w join rules r on r.service = w.service and r.sli_type = 'error_rate'""").replace("\n, steps as", ",\nsteps as", 1),
    "throughput_alerts": sql("rates rules", """, w as (select *, avg(rps) over (partition by service order by epoch(hour)::bigint range between 86399 preceding and current row) as l, avg(rps) over (partition by service order by epoch(hour)::bigint range between 21599 preceding and current row) as s from rates)
        select w.service, w.win, count(*) filter (l < round(sla_target, 7) * (1 - burn_rate * error_budget_percent / 100) and s < round(sla_target, 7) * (1 - burn_rate * error_budget_percent / 100)) as firing, count(*) as steps from w join rules r on r.service = w.service and r.sli_type = 'throughput' and r.severity = 'warning' group by all""").replace("\n, w as", ",\nw as", 1),
    "latest_artifact": sql("newest", "select service, artifact_type, payload, stored_at from newest where turn = 1"),
    "artifact_history": sql("newest", "select service, artifact_type, turn::int as turn, payload from newest where turn <= 10"),
    "list_services": sql("arts", "select distinct service from arts"),
    "service_status": sql("status", "select * exclude (breached) from status"),
    "fleet_summary": sql("status", "select count(*) as total_services, " + ", ".join(f"count(*) filter (status = '{s}') as {s}" for s in ("healthy", "degraded", "critical", "improving", "baselined", "unknown")) + " from status"),
    "drift_monitor": sql("status", "select service, drift_class, drift_severity, case coalesce(drift_severity, 'info') when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 when 'info' then 4 else 5 end as severity_rank, coalesce(drift_class, '') <> 'no_significant_drift' as drifting from status where has_drift_signal"),
    "recommendations": "select 'svc-' || s as service, sum(n)::bigint as open, (max(n) - 1)::int as last_place from (select l_suppkey % 50 as s, l_orderkey, count(*) as n from lineitem group by all) group by s",
    "cited_numbers": """select l_orderkey, l_linenumber, list_aggregate(list_transform(list_filter([round(l_extendedprice, 0)::bigint, l_suppkey, 7], lambda x: x <> 0), lambda x: x || '.0'), 'string_agg', ',') as cited from lineitem""",
    "cited_in_conversations": r"""select role, sum(len(regexp_extract_all(coalesce(text, ''), '[0-9]+')))::bigint as numbers, count(*) filter (regexp_matches(text, '(?i)\b(?:kubectl|oc|curl|docker|helm)\b|```(?:yaml|yml|json)\b|\b(?:POST|PUT|PATCH|DELETE)\s+https?://')) as actuation from conversations group by role""",
    "grounding": sql("vals", """select v.service, count(*) filter (l_quantity = 0 or len(list_filter(vals, lambda x: x <> 0 and abs(l_quantity - x) / greatest(abs(x), 1e-10) < 0.02)) > 0) as grounded, count(*) as n from lineitem l join vals v on v.service = 'svc-' || lpad((l_suppkey % 10)::varchar, 2, '0') group by v.service"""),
    "actuation_hits": "select doc_id, doc_id % 3 <> 2 or regexp_matches(text, '(?i)\\b(?:kubectl|oc|curl|docker|helm)\\b|```(?:yaml|yml|json)\\b|\\b(?:POST|PUT|PATCH|DELETE)\\s+https?://') as hit from documents",
    "scorecard": "select coalesce(o_orderstatus, 'all') as model, coalesce(o_orderpriority, 'all') as prompt, count(*) as attempts, round(avg((o_totalprice > 100000)::int), 5) as pass_rate, round(avg(o_totalprice / 1000), 5) as mean_latency_s from orders group by cube (o_orderstatus, o_orderpriority)",
    "audit_hash": sql("sections", "select doc_id, section, payload, sha256(payload) as sha256 from sections"),
    "audit_verify": "select case doc_id % 10 when 0 then 'missing hash' when 1 then 'hash mismatch' when 2 then 'orphan hash' else 'none' end as problem, count(*) as n from documents group by 1",
    "reproducible": "select 0::bigint as differences",
    "batch_indicators": sql("wins", """, rows as (select service, ws, unnest([5.0::double, 10, 25, 50, 100, 250, 500, 'inf'::double]) as le, latency_ms, is_error from wins),
        cum as (select service, ws, le, count(*) filter (latency_ms <= le) as cum from rows group by all),
        bk as (select *, lag(cum, 1, 0) over w as pc, lag(le, 1, 0.0) over w as pb, max(cum) over (partition by service, ws) as total from cum window w as (partition by service, ws order by le)),
        p as (select service, ws, """ + ", ".join(
        f"coalesce(min_by(pb + case when cum <= pc then 0.0 else ({q} * total - pc) / (cum - pc) end * (le - pb), le) filter (le < 'inf' and cum >= {q} * total), max(le) filter (le < 'inf')) as {n}"
        for n, q in (("p99_ms", 0.99), ("p50_ms", 0.5))) + """ from bk group by all)
        select service, epoch(ws + interval 1 day)::bigint as epoch, n, round(e, 6) as error_ratio, round(p99_ms, 6) as p99_ms, round(p50_ms, 6) as p50_ms from p join (select service, ws, count(*) as n, avg(is_error::int) as e from wins group by all) using (service, ws)"""),
    "batch_record": sql("req prop", "select r.service, epoch(time_bucket(interval 5 minute, ts))::bigint as epoch, round(count(*) / 300, 6) as rps, round(avg(is_error::int), 6) as error_ratio, round(avg((latency_ms <= round(sla_target, 4))::int), 6) as good_ratio from req r join prop p on p.service = r.service and p.sli_type = 'latency' group by all"),
    "batch_cpu": "select 'svc-' || lpad((l_suppkey % 10)::varchar, 2, '0') as service, epoch(l_shipdate::timestamp)::bigint // 300 * 300 as epoch, round(avg(l_quantity / 50), 6) as cpu from lineitem group by all",
}


def _named(needs: str, select: str, columns: str = "*") -> str:
    """A query whose services are told apart by namespace and name: one name of both parts inside, two columns in its result."""
    text = sql(needs, f"select split_part(service, '/', 1) as namespace, split_part(service, '/', 2) as service, {columns} from ({select})")
    for number, name in (("user_id", "'svc-' || lpad((user_id % 10)::varchar, 2, '0') as service"), ("o_custkey", "'svc-' || (o_custkey % 50)::varchar as service")):
        text = text.replace(name, f"case when {number} % 20 < 10 then 'shop' else 'core' end || '/' || {name}")
    return text


_REST = "* exclude (service)"
_STATUS_COUNTS = ", ".join(f"count(*) filter (status = '{s}') as {s}" for s in ("healthy", "degraded", "critical", "improving", "baselined", "unknown"))
ORACLE_SQL |= {
    "baseline_by_namespace": _named(
        "latency errs thr",
        f"select service, win, {_LAT}, sample_count, total_count, error_count, {rounded('error_ratio error_stddev availability mean_rps stddev_rps p95_rps', 5)}, rate_samples from latency join errs using (service, win) join thr using (service, win)",
        _REST,
    ),
    "error_ratio_by_namespace": _named("req", "select service, epoch(date_trunc('second', ts))::bigint // 21600 * 21600 as epoch, count(*) as n, count(*) filter (is_error) as hits, round(count(*) filter (is_error) / count(*), 6) as ratio from req group by all", _REST),
    "rate_by_namespace": _named(
        "req",
        """select service, epoch // 3600 * 3600 as epoch, round(sum(case when prev is null then 0.0 when latency_ms < prev then latency_ms else latency_ms - prev end) / 3600, 6) as rps
        from (select service, latency_ms, epoch(date_trunc('second', ts))::bigint as epoch, lag(latency_ms) over (partition by service, code order by ts, event_id) as prev from req) group by all""",
        _REST,
    ),
    "status_by_namespace": _named("status", "from status", "* exclude (service, breached)"),
    "fleet_by_namespace": f"select namespace, count(*) as total_services, {_STATUS_COUNTS} from ({_named('status', 'from status', 'status')}) group by namespace",
    "drift_monitor_by_namespace": _named("status", ORACLE_SQL["drift_monitor"].rsplit("\n", 1)[1], _REST),
    "latest_by_namespace": _named("newest", "select service, artifact_type, payload, stored_at from newest where turn = 1", _REST),
    "batch_record_by_namespace": _named(
        "req",
        """select r.service, epoch(time_bucket(interval 5 minute, ts))::bigint as epoch, round(count(*) / 300, 6) as rps, round(avg(is_error::int), 6) as error_ratio, round(avg((latency_ms <= sla_target)::int), 6) as good_ratio
        from req r join (select service, quantile_disc(latency_ms, 0.5) as sla_target from req group by service) t on t.service = r.service group by all""",
        _REST,
    ),
}
