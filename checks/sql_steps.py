"""Named SQL statements the checks build on: ship maps, routing, signals."""

from __future__ import annotations

import re

from lanewise import params as P

FCS = ", ".join(f"'{fc}'" for fc in P.FCS)
PREFERRED = ", ".join(f"'{fc}'" for fc in P.PREFERRED_FCS)
DAYS = "between date '2025-11-01' and date '2025-11-14'"
MAP_DAYS = "between date '2025-11-01' and date '2025-11-17'"


def clock(c: str) -> str:
    return f"substr({c}, 1, 2) || ':' || substr({c}, 3, 2) || ':' || substr({c}, 5, 2)"


def ship_map(modes: str) -> str:
    digits = (
        "lpad(cast(case when cutoff >= 240000 then cutoff - 240000 else cutoff end "
        "as varchar), 6, '0')"
    )
    return f"""
        select shipdate, fcname, zip5, mode, routeid, zone, {clock('digits')} as cutoff,
               tnt, adjtnt, nextadjtnt
        from (select ship_date as shipdate, fc as fcname, zip5, mode, routeid, zone,
                     {digits} as digits, tnt, adjtnt, nextadjtnt, generate_date,
                     max(generate_date) over (partition by ship_date, fc, zip5) as newest
              from ship_map_raw
              where fc in ({FCS}) and mode in ({modes}) and item_type = 'N'
                and ship_date {MAP_DAYS})
        where generate_date = newest
    """


STEPS = {
    "smap_baseline": ship_map("'FDXHD', 'ONTRGD'"),
    "smap_remediation": ship_map("'FDXHD'"),
    "smap_expansion": f"""
        select * from smap_baseline
        union
        select shipdate, fcname, zip5, mode, routeid, zone,
               {clock("replace(cutoff, ':', '')")} as cutoff, tnt, adjtnt, nextadjtnt
        from eligible_lanes where fcname <> 'HOU1' and shipdate {MAP_DAYS}
    """,
    "smap_custom": """
        select distinct m.* from smap_baseline m
        where not exists (select 1 from removal_zips r
                          where lpad(cast(r.zip5 as varchar), 5, '0') = m.zip5
                            and m.mode = 'ONTRGD')
    """,
    "packages": f"""
        select * from shipments
        where fc_name in ({FCS}) and cast(order_placed_ts as date) {DAYS}
    """,
    "stocked": f"""
        select p.order_id, p.tracking_number, p.zip5, p.order_placed_ts, l.order_line_id,
               i.fc_name
        from packages p
        join order_lines l
          on p.order_id = l.order_id and p.tracking_number = l.tracking_number
        join inventory i
          on i.order_id = l.order_id and i.order_line_id = l.order_line_id
        where i.quantity_available >= l.qty and l.order_placed_date {DAYS}
    """,
    "candidates": """
        select f.order_id, f.tracking_number, f.zip5, f.order_placed_ts, f.fc_name
        from (select order_id, tracking_number, zip5, order_placed_ts, fc_name,
                     count(distinct order_line_id) as n
              from stocked group by all) f
        join (select order_id, tracking_number, count(distinct order_line_id) as n
              from stocked group by all) t
          on f.order_id = t.order_id and f.tracking_number = t.tracking_number
             and f.n = t.n
    """,
    "sides": """
        select *, cast(actual_ship_ts as date) as ship_date,
               case when length is null or width is null or height is null then null
                    else greatest(length, width, height) end as longest_side,
               case when length is null or width is null or height is null then null
                    else list_sort([length, width, height])[2] end as second_side,
               case when length is null or width is null or height is null then null
                    else least(length, width, height) end as third_side,
               ceil(length * width * height / 166) as dim_weight,
               case when weight is null or length * width * height is null then null
                    else ceil(greatest(weight, length * width * height / 166))
                    end as bill_weight
        from shipments
    """,
    "dims": """
        select *,
               case when longest_side between 96.001 and 108
                      or length_plus_girth between 130.001 and 165
                    then greatest(bill_weight, 90)
                    when (longest_side between 48.001 and 96 or second_side > 30
                          or length_plus_girth between 105.001 and 130)
                     and ship_date >= date '2025-01-13'
                    then greatest(bill_weight, 40)
                    else bill_weight end as charged_weight
        from (select *, longest_side + 2 * (second_side + third_side) as length_plus_girth
              from sides)
    """,
}


def cost_steps(tag: str) -> dict[str, str]:
    interval = "l.ship_date between {c}.start_date and {c}.end_date"

    def band(card: str, alias: str, measure: str, column: str) -> str:
        return f"""
            left join {card} {alias} on {alias}.carrier_code = l.mode
              and {alias}.zone = l.zone and {interval.format(c=alias)}
              and l.{measure} > {alias}.{column}_lower
              and l.{measure} <= {alias}.{column}_upper
        """

    return {
        f"cost_lanes_{tag}": f"""
            select c.order_id, c.tracking_number, c.fc_name, c.zip5, z.mode, z.zone,
                   d.ship_date, d.weight, d.longest_side, d.second_side,
                   d.length_plus_girth, d.charged_weight
            from candidates c
            join (select distinct shipdate, fcname, zip5, mode, zone from smap_{tag}) z
              on z.zip5 = c.zip5 and z.fcname = c.fc_name
                 and z.shipdate = cast(c.order_placed_ts as date)
            join dims d
              on d.order_id = c.order_id and d.tracking_number = c.tracking_number
             and cast(d.order_placed_ts as date) {DAYS}
        """,
        f"charges_{tag}": f"""
            select l.*, br.base_charge as base_rate, r.resi_amount,
                   das.amount as das_amount, pk.peak_surcharge as peak_amount,
                   f.fsc_per as fuel_amount,
                   ls.amount as long_amount, ls.charge_type as long_type,
                   ss.amount as second_amount, ss.charge_type as second_type,
                   lg.amount as girth_amount, lg.charge_type as girth_type,
                   wt.amount as heavy_amount, wt.charge_type as heavy_type
            from cost_lanes_{tag} l
            left join base_rates br on br.carrier_code = l.mode and br.zone = l.zone
              and br.bill_weight = l.charged_weight and {interval.format(c='br')}
            left join resi r on r.carrier_code = l.mode and {interval.format(c='r')}
            left join das on das.carrier_code = l.mode and das.zipcode = l.zip5
              and {interval.format(c='das')}
            {band('weight_bands', 'wt', 'weight', 'weight')}
            {band('longest_bands', 'ls', 'longest_side', 'longest_side')}
            {band('second_bands', 'ss', 'second_side', 'second_longest_side')}
            {band('girth_bands', 'lg', 'length_plus_girth', 'length_plus_girth')}
            left join peak pk on pk.shipmode = l.mode
              and pk.peak_surcharge_application_week
                  = cast(date_trunc('week', l.ship_date) as date)
            left join fuel f on f.carrier_code = l.mode
              and l.ship_date between f.start_dt and f.end_dt
        """,
        f"classed_{tag}": f"""
            select *,
              case when 'unauthorized_oversize' in (coalesce(long_type, ''),
                        coalesce(girth_type, ''), coalesce(heavy_type, ''))
                   then 'unauthorized_oversize'
                   when 'oversize' in (coalesce(long_type, ''), coalesce(girth_type, ''))
                   then 'oversize'
                   when 'additional_handling' in (coalesce(long_type, ''),
                        coalesce(girth_type, ''), coalesce(second_type, ''),
                        coalesce(heavy_type, ''))
                   then 'additional_handling' end as handling_class,
              greatest(coalesce(long_amount, 0), coalesce(second_amount, 0),
                       coalesce(girth_amount, 0), coalesce(heavy_amount, 0)) as top_amount
            from charges_{tag}
        """,
        f"costs_{tag}": f"""
            select distinct order_id, tracking_number, fc_name, mode, zone,
              (base_rate + coalesce(resi_amount, 0) + coalesce(das_amount, 0)
               + cast(0.01 as double)
               + case when handling_class is null then 0 else top_amount end
               + coalesce(peak_amount, 0)) * (1 + fuel_amount) as total_amount
            from classed_{tag}
        """,
        f"options_{tag}": f"""
            select c.order_id, c.tracking_number, c.zip5,
                   cast(c.order_placed_ts as date) as order_placed_date, c.fc_name,
                   m.mode, m.routeid, m.zone,
                   case when cast(cast(cast(c.order_placed_ts as date) as varchar) || ' '
                                  || m.cutoff as timestamp) >= p.release_ts
                        then m.adjtnt else m.nextadjtnt end as tnt,
                   k.total_amount, coalesce(g.dist_miles, 10000) as distance
            from candidates c
            join (select distinct order_id, tracking_number, release_ts from shipments) p
              on p.order_id = c.order_id and p.tracking_number = c.tracking_number
            join smap_{tag} m on m.zip5 = c.zip5 and m.fcname = c.fc_name
              and m.shipdate = cast(c.order_placed_ts as date)
            left join fc_zip_distance g on g.postcode = c.zip5 and g.fc_name = c.fc_name
            left join costs_{tag} k on k.order_id = c.order_id
              and k.tracking_number = c.tracking_number and k.fc_name = c.fc_name
              and k.mode = m.mode
        """,
        f"ranked_{tag}": f"""
            select *, total_amount + tnt_penalty as cost,
                   max(case when row_n = 1 then total_amount + tnt_penalty else 0 end)
                     over (partition by order_id, tracking_number) as selected_cost
            from (select *, row_number() over (
                        partition by order_id, tracking_number
                        order by total_amount asc nulls last,
                          case when fc_name in ({PREFERRED}) then 0 else 1 end,
                          case when tnt = 1 then 2 else tnt end asc nulls last,
                          tnt desc nulls last, distance asc nulls last,
                          mode, fc_name, routeid) as row_n
                  from (select *, cast(case when tnt <= 2 then 2.1 when tnt = 3 then 2.4
                                 when tnt = 4 then 2.8 when tnt = 5 then 3.6
                                 when tnt = 6 then 35.1 when tnt = 7 then 36.1
                                 when tnt = 8 then 37.1 when tnt >= 9 then 38.1 end
                                 as double) as tnt_penalty
                        from options_{tag}))
        """,
        f"neutral_{tag}": f"""
            select order_id, tracking_number,
                   string_agg(distinct fc_name, ',' order by fc_name) as cost_neutral_fc
            from ranked_{tag} where cost = selected_cost group by all
        """,
        f"routing_{tag}": f"""
            select distinct w.order_id, w.tracking_number, w.zip5, w.order_placed_date,
                   w.fc_name as sim_fc_name, w.mode as sim_carrier_code,
                   w.routeid as sim_route, w.total_amount as sim_transit_cost,
                   w.tnt_penalty as sim_tnt_penalty, w.zone as sim_zone, w.tnt as sim_tnt,
                   n.cost_neutral_fc, p.fc_name as act_fc_name,
                   p.carrier_code as act_carrier_code, p.route as act_route,
                   k.total_amount as act_transit_cost,
                   cast(p.actual_ship_ts as date) as ship_date, p.units,
                   date_diff('day', cast(p.order_placed_ts as date),
                             cast(p.first_attempt_ts as date)) as ctd,
                   date_diff('day', cast(p.actual_ship_ts as date),
                             cast(p.first_attempt_ts as date)) as std,
                   case when p.promised_date >= cast(p.first_attempt_ts as date) then 1
                        when p.first_attempt_ts is null then null else 0 end as dea_flag
            from ranked_{tag} w
            join shipments p
              on p.order_id = w.order_id and p.tracking_number = w.tracking_number
            left join costs_{tag} k on k.order_id = w.order_id
              and k.tracking_number = w.tracking_number and k.fc_name = p.fc_name
              and k.mode = p.carrier_code
            left join neutral_{tag} n on n.order_id = w.order_id
              and n.tracking_number = w.tracking_number
            where w.row_n = 1
        """,
    }


for _tag in ("baseline", "remediation", "expansion"):
    STEPS.update(cost_steps(_tag))


def renamed(text: str, names: dict[str, str]) -> str:
    return re.sub(r"\w+(?!\.)", lambda m: names.get(m[0], m[0]), text)


def over(suffix: str, *inputs: str, last: str | None = None) -> dict[str, str]:
    """The steps that depend on the inputs, over inputs of another name.

    They take the suffix, and so do the inputs; ``last`` is the last step
    wanted.
    """
    names = {name: f"{name}_{suffix}" for name in inputs}
    found = {}
    for name, text in STEPS.items():
        if names.keys() & set(re.findall(r"\w+", text)):
            names[name] = f"{name}_{suffix}"
            found[names[name]] = renamed(text, names)
        if name == last:
            break
    return found


STEPS |= over("again", "shipments", last="routing_baseline")
STEPS |= over("two", "longest_bands", "resi", last="routing_baseline")

CHALLENGER_DAY = "mode = 'ONTRGD' and shipdate = date '2025-11-14'"


def per_carrier(values: dict[str, str]) -> str:
    return ", ".join(
        f"{expr.format(c=c)} as {c}_{name}"
        for c in ("FDXHD", "ONTRGD")
        for name, expr in values.items()
    )


def switch(tag: str) -> str:
    def moved(column: str) -> str:
        return (
            f"count(distinct case when b.base_{column} <> s.sim_{column} then "
            f"b.base_{column} || '>' || s.sim_{column} || '>' || b.tracking_number end)"
        )

    return f"""
        select *, fc_switch_package_count / package_count as fc_switch_package_per
        from (select b.zip5, count(distinct b.tracking_number) as package_count,
                     {moved('fc_name')} as fc_switch_package_count,
                     {moved('carrier_code')} as carrier_switch_package_count
              from base b join routing_{tag} s
                on s.order_id = b.order_id and s.tracking_number = b.tracking_number
               and s.order_placed_date = b.order_placed_date and s.zip5 = b.zip5
              group by b.zip5)
    """


STEPS.update(
    {
        "base": """
            select order_id, tracking_number, order_placed_date, zip5, units,
                   sim_fc_name as base_fc_name, sim_carrier_code as base_carrier_code,
                   sim_tnt as base_tnt, sim_transit_cost as base_transit_cost,
                   act_fc_name, act_carrier_code, act_transit_cost, std, dea_flag
            from routing_baseline
        """,
        "switch_remediation": switch("remediation"),
        "switch_expansion": switch("expansion"),
        "volume": """
            select zip5, count(distinct tracking_number)
                   / (select count(distinct order_placed_date) from base)
                   as daily_package_count_avg
            from base group by zip5
        """,
        "transit": """
            select day_of_week, zip5, carrier_code, weighted_adjtnt, package_count,
                   adjtnt_avg,
                   case when package_count > 0 then weighted_adjtnt / package_count
                        else adjtnt_avg end as weighted_adjtnt_avg
            from (select m.day_of_week, m.zip5, m.mode as carrier_code,
                         cast(sum(coalesce(n, 0) * adjtnt) as bigint) as weighted_adjtnt,
                         cast(sum(coalesce(n, 0)) as bigint) as package_count,
                         avg(adjtnt) as adjtnt_avg
                  from (select *, cast(isodow(shipdate) - 1 as int) as day_of_week
                        from smap_baseline) m
                  left join (select cast(isodow(order_placed_date) - 1 as int) as day_of_week,
                                    zip5, act_fc_name, count(distinct tracking_number) as n
                             from base group by all) s
                    on s.day_of_week = m.day_of_week and s.zip5 = m.zip5
                   and s.act_fc_name = m.fcname
                  group by all)
        """,
        "service": f"""
            select unpadded_edd, fc as fc_name, carrier_code, zip as zip5,
                   cast(sum(total) - sum(failures) as bigint) as on_time_count,
                   cast(sum(total) as bigint) as package_count
            from service_failures
            where fc in ({FCS})
              and unpadded_edd between date '2025-11-01' and date '2025-11-30'
            group by all
        """,
        "service_reason": f"""
            select *, case when (ONTRGD_unpadded_edd_dea < 0.5) = (FDXHD_unpadded_edd_dea < 0.5)
                           then 'ok'
                           when ONTRGD_unpadded_edd_dea < 0.5
                            and FDXHD_unpadded_edd_dea >= 0.5 then 'deactivate'
                      end as reason_code_dea
            from (select zip5, {per_carrier({
                'unpadded_edd_dea': "max(case when carrier_code = '{c}' then rate end)",
                'act_package_count':
                    "max(case when carrier_code = '{c}' then packages end)",
            })}
                  from (select zip5, carrier_code,
                               cast(sum(package_count) as bigint) as packages,
                               sum(on_time_count) / sum(package_count) as rate
                        from service group by all
                        having count(distinct unpadded_edd) >= 3)
                  group by zip5)
        """,
        "station_rows": """
            select run_date as date, carrier, dest_facility_num, days_behind
            from (select *, row_number() over (
                            partition by run_date, carrier, dest_facility_num
                            order by row_created_date desc nulls first,
                                     days_behind desc nulls last) as rn
                  from station_backlog where carrier is not null)
            where rn = 1
        """,
        "station_a": """
            select zip5, dest_facility_num
            from (select *, row_number() over (partition by zip5 order by
                            snapshot_date desc, dest_facility_num) as rn
                  from (select distinct lpad(zipcode, 5, '0') as zip5, snapshot_date,
                               cast(right(master_term, 3) as int) as dest_facility_num
                        from station_zip_a))
            where rn = 1
        """,
        "backlog": """
            select distinct r.date, r.dest_facility_num,
                   coalesce(a.zip5, b.zip5) as zip5, r.days_behind,
                   case r.carrier when 'FedEx' then 'FDXHD' when 'OnTrac' then 'ONTRGD'
                   end as carrier_code
            from station_rows r
            left join station_a a
              on a.dest_facility_num = r.dest_facility_num and r.carrier = 'FedEx'
            left join (select distinct lpad(customer_zip, 5, '0') as zip5,
                              dest_facility_num from station_zip_b) b
              on b.dest_facility_num = r.dest_facility_num and r.carrier = 'OnTrac'
        """,
        "backlog_day": """
            select max(date) as date
            from (select date from backlog where carrier_code in ('FDXHD', 'ONTRGD')
                  group by date having count(distinct carrier_code) = 2)
        """,
        "backlog_reason": f"""
            select *, case when FDXHD_days_behind >= 0.25 then 'activate'
                           when ONTRGD_days_behind >= 0.25 then 'deactivate'
                           when FDXHD_days_behind < 0.25 and ONTRGD_days_behind < 0.25
                           then 'ok' end as reason_code_backlog
            from (select zip5, {per_carrier({
                'days_behind': "arg_min(days_behind, dest_facility_num) "
                    "filter (carrier_code = '{c}' and days_behind is not null)",
            })}
                  from backlog
                  where date = (select date from backlog_day) and zip5 is not null
                  group by zip5)
        """,
        "shutdown_clear": """
            select z.zip5, c.carrier_code,
                   case when s.end_date is not null then s.end_date
                        when s.zip5 is null then date '2025-11-15'
                        else date '9999-12-31' end as end_date,
                   greatest(
                     cast(case when s.end_date is not null then s.end_date
                               when s.zip5 is null then date '2025-11-15'
                               else date '9999-12-31' end as timestamp),
                     timestamp '2025-11-15' + to_microseconds(cast(round(
                       coalesce(t.weighted_adjtnt_avg, 2) * 86400000000) as bigint))
                   ) as clear
            from (select distinct zip5 from shutdowns where start_date = date '2025-11-16') z
            cross join (values ('FDXHD'), ('ONTRGD')) c(carrier_code)
            left join shutdowns s on s.zip5 = z.zip5 and s.carrier_code = c.carrier_code
              and s.start_date = date '2025-11-16'
            left join transit t on t.zip5 = z.zip5 and t.carrier_code = c.carrier_code
              and t.day_of_week = isodow(date '2025-11-15') - 1
        """,
        "shutdown_reason": f"""
            select *, case when epoch_us(ONTRGD_clear) - epoch_us(FDXHD_clear) >= 86400000000
                           then 'deactivate'
                           when epoch_us(FDXHD_clear) - epoch_us(ONTRGD_clear) >= 86400000000
                           then 'activate' else 'ok' end as reason_code_shutdown
            from (select zip5, {per_carrier({
                'end_date': "min(case when carrier_code = '{c}' then end_date end)",
                'clear': "min(case when carrier_code = '{c}' then clear end)",
            })}
                  from shutdown_clear group by zip5)
        """,
        "last_rows": """
            select * from (
              select *, row_number() over (partition by source, zip5
                                           order by run_dttm desc, run_name desc) as rn
              from recommendation_history
              where cast(run_dttm as date) >= date '2025-09-16'
                and cast(run_dttm as date) < date '2025-11-15' and zip_count_tag = 'all')
            where rn = 1 and run_name = 'default'
        """,
        "last_decision": """
            select zip5, final_recommendation as last_recommendation,
                   strftime(run_dttm, '%Y-%m-%d') as recommendation_date,
                   final_reason_dea as last_reason_dea,
                   final_reason_shutdown as last_reason_shutdown,
                   final_reason_backlog as last_reason_backlog
            from (select *, row_number() over (partition by zip5
                            order by run_dttm desc, source asc) as newest
                  from last_rows)
            where newest = 1
        """,
        "status": f"""
            select e.zip5, case when b.zip5 is null then 0 else 1 end as active
            from (select distinct zip5 from smap_expansion where {CHALLENGER_DAY}) e
            left join (select distinct zip5 from smap_baseline where {CHALLENGER_DAY}) b
              on b.zip5 = e.zip5
        """,
        "signals": """
            select s.zip5, s.active,
                   case when s.active = 1 then r.fc_switch_package_per
                        else x.fc_switch_package_per end as fc_switch_package_per,
                   v.daily_package_count_avg,
                   d.FDXHD_unpadded_edd_dea, d.ONTRGD_unpadded_edd_dea,
                   d.FDXHD_act_package_count, d.ONTRGD_act_package_count,
                   d.reason_code_dea, k.FDXHD_days_behind, k.ONTRGD_days_behind,
                   k.reason_code_backlog,
                   coalesce(l.last_recommendation, 'None') as last_recommendation,
                   l.recommendation_date,
                   coalesce(l.last_reason_dea, 'None') as last_reason_dea,
                   coalesce(l.last_reason_shutdown, 'None') as last_reason_shutdown,
                   coalesce(l.last_reason_backlog, 'None') as last_reason_backlog
            from status s
            left join switch_remediation r on r.zip5 = s.zip5
            left join switch_expansion x on x.zip5 = s.zip5
            left join volume v on v.zip5 = s.zip5
            left join service_reason d on d.zip5 = s.zip5
            left join backlog_reason k on k.zip5 = s.zip5
            left join last_decision l on l.zip5 = s.zip5
        """,
        "today": """
            select *,
              case when reason_code_dea in ('activate', 'deactivate') then reason_code_dea
                   when reason_code_backlog in ('activate', 'deactivate')
                   then reason_code_backlog
                   when reason_code_dea = 'ok' or reason_code_backlog = 'ok' then 'ok'
                   else 'None' end as current_recommendation,
              case when reason_code_dea in ('activate', 'deactivate', 'ok')
                    and not (reason_code_dea = 'ok' and coalesce(reason_code_backlog, '')
                             in ('activate', 'deactivate'))
                   then reason_code_dea else 'None' end as current_reason_dea,
              'None' as current_reason_shutdown,
              case when coalesce(reason_code_dea, '') in ('activate', 'deactivate')
                   then 'None'
                   when reason_code_backlog in ('activate', 'deactivate')
                   then reason_code_backlog
                   when coalesce(reason_code_dea, '') = 'ok' then 'None'
                   else coalesce(reason_code_backlog, 'None') end as current_reason_backlog,
              last_reason_dea = 'ok' and last_reason_shutdown = 'ok'
                and last_reason_backlog = 'ok' as all_ok,
              (active = 0 and last_recommendation = 'activate')
                or (active = 1 and last_recommendation = 'deactivate') as contradicted
            from signals
        """,
        "believed": """
            select *,
              case when contradicted and all_ok
                   then case last_recommendation when 'activate' then 'deactivate'
                        else 'activate' end
                   when contradicted then 'None' else last_recommendation end as prior,
              case when contradicted then 'None' else last_reason_dea end as prior_dea,
              all_ok and not contradicted as prior_ok
            from today
        """,
        "outcome": """
            select *, case
              when prior = 'deactivate' and prior_dea = 'deactivate' then 'nothing'
              when current_recommendation in ('activate', 'deactivate') then 'today'
              when prior in ('activate', 'deactivate') and prior_ok then 'nothing'
              when current_recommendation = 'ok' and prior = 'activate' then 'off'
              when current_recommendation = 'ok' and prior = 'deactivate' then 'on'
              else 'nothing' end as outcome
            from believed
        """,
        "master": """
            select zip5, active, fc_switch_package_per, daily_package_count_avg,
              FDXHD_unpadded_edd_dea, ONTRGD_unpadded_edd_dea, FDXHD_act_package_count,
              ONTRGD_act_package_count, reason_code_dea, FDXHD_days_behind,
              ONTRGD_days_behind, reason_code_backlog, current_recommendation,
              current_reason_dea, current_reason_shutdown, current_reason_backlog,
              last_recommendation, recommendation_date, last_reason_dea,
              last_reason_shutdown, last_reason_backlog,
              case outcome when 'today' then current_recommendation
                           when 'off' then 'deactivate' when 'on' then 'activate'
                           else 'None' end as final_recommendation,
              case outcome when 'today' then current_reason_dea when 'off' then 'ok'
                           when 'on' then 'ok' else 'None' end as final_reason_dea,
              case outcome when 'today' then current_reason_shutdown when 'off' then 'ok'
                           when 'on' then 'ok' else 'None' end as final_reason_shutdown,
              case outcome when 'today' then current_reason_backlog when 'off' then 'ok'
                           when 'on' then 'ok' else 'None' end as final_reason_backlog
            from outcome
        """,
        "allowed": """
            select * from master
            where daily_package_count_avg >= 1 and fc_switch_package_per <= 0.9
        """,
        "groups": """
            select 'remediation' as side, *, ONTRGD_unpadded_edd_dea as unpadded_edd_dea,
                   ONTRGD_act_package_count as act_package_count,
                   ONTRGD_days_behind as days_behind
            from allowed where active = 1 and final_recommendation = 'deactivate'
            union all
            select 'expansion', *, FDXHD_unpadded_edd_dea, FDXHD_act_package_count,
                   FDXHD_days_behind
            from allowed where active = 0 and final_recommendation = 'activate'
        """,
        "filled": """
            select side, zip5,
                   coalesce(act_package_count, avg(act_package_count) over w) as volume,
                   coalesce(unpadded_edd_dea, avg(unpadded_edd_dea) over w) as rate,
                   coalesce(days_behind, avg(days_behind) over w) as behind
            from groups window w as (partition by side)
        """,
        "scored": """
            select side, zip5,
              0.65 * case when max(volume) over w = min(volume) over w then 0
                     else (volume - min(volume) over w)
                          / (max(volume) over w - min(volume) over w) end
              + 0.25 * (1 - case when max(rate) over w = min(rate) over w then 0
                     else (rate - min(rate) over w)
                          / (max(rate) over w - min(rate) over w) end)
              + 0.10 * case when max(behind) over w = min(behind) over w then 0
                     else (behind - min(behind) over w)
                          / (max(behind) over w - min(behind) over w) end
              as priority_score
            from filled window w as (partition by side)
        """,
        "removal_cells": """
            select zip5, act_carrier_code as c, count(distinct tracking_number) as n,
                   cast(sum(cast(act_transit_cost as decimal(18, 6))) as double)
                     / nullif(count(act_transit_cost), 0) as cost, avg(std) as std,
                   round_even(coalesce(sum(dea_flag), 0)
                              / count(distinct tracking_number), 4) as rate
            from base where std is not null group by all
        """,
        "removal_scaled": """
            select zip5, dea_per_change, cost_change, std_change,
              (dea_per_change - min(dea_per_change) over ())
                / nullif(max(dea_per_change) over () - min(dea_per_change) over (), 0) as d,
              (cost_change - min(cost_change) over ())
                / nullif(max(cost_change) over () - min(cost_change) over (), 0) as k,
              (std_change - min(std_change) over ())
                / nullif(max(std_change) over () - min(std_change) over (), 0) as s
            from (select o.zip5, o.rate - f.rate as dea_per_change,
                         f.cost - o.cost as cost_change, f.std - o.std as std_change
                  from removal_cells o join removal_cells f on f.zip5 = o.zip5
                  where o.c = 'ONTRGD' and f.c = 'FDXHD')
        """,
        "remediation_scores": """
            select *, cast(sum(carrier_switch_package_count)
                        over (order by priority_score nulls last, zip5
                              rows unbounded preceding) as bigint)
                        as carrier_switch_package_count_cumsum,
                   sum(package_count) over (order by priority_score nulls last, zip5
                              rows unbounded preceding)
                     / sum(package_count) over () as package_count_cumsum_per
            from (select s.zip5, s.dea_per_change, s.cost_change, s.std_change,
                         0.7 * d + 0.2 * k + 0.1 * s.s as priority_score,
                         v.package_count, v.carrier_switch_package_count
                  from removal_scaled s
                  join (select zip5, count(distinct tracking_number) as package_count,
                               count(distinct case when base_carrier_code = 'ONTRGD'
                                     then tracking_number end)
                                 as carrier_switch_package_count
                        from base where std is not null group by zip5) v
                    on v.zip5 = s.zip5
                  where v.carrier_switch_package_count > 0)
        """,
        "opened": """
            select b.zip5, coalesce(sum(s.sim_transit_cost), 0)
                             - coalesce(sum(b.base_transit_cost), 0) as cost_change,
                   avg(s.sim_tnt) - avg(b.base_tnt) as tnt_change
            from base b join routing_expansion s
              on s.order_id = b.order_id and s.tracking_number = b.tracking_number
             and s.order_placed_date = b.order_placed_date and s.zip5 = b.zip5
            group by b.zip5
        """,
        "expansion_all": """
            select o.zip5, o.cost_change, o.tnt_change, w.package_count,
                   w.carrier_switch_package_count, w.fc_switch_package_per,
                   case when a.zip5 is null then 0 else 1 end as active,
                   0.7 * (o.cost_change - min(o.cost_change) over ())
                     / nullif(max(o.cost_change) over () - min(o.cost_change) over (), 0)
                   + 0.3 * (o.tnt_change - min(o.tnt_change) over ())
                     / nullif(max(o.tnt_change) over () - min(o.tnt_change) over (), 0)
                   as priority_score
            from opened o join switch_expansion w on w.zip5 = o.zip5
            left join (select zip5 from smap_baseline where mode = 'ONTRGD'
                       intersect
                       select zip5 from smap_expansion where mode = 'ONTRGD') a
              on a.zip5 = o.zip5
        """,
        "expansion_scores": """
            select *, cast(sum(carrier_switch_package_count)
                        over (order by priority_score nulls last, zip5
                              rows unbounded preceding) as bigint)
                        as carrier_switch_package_count_cumsum,
                   sum(package_count) over (order by priority_score nulls last, zip5
                              rows unbounded preceding)
                     / sum(package_count) over () as package_count_cumsum_per
            from expansion_all where active = 0 and fc_switch_package_per <= 0.9
        """,
        "chosen": """
            select distinct zip5 from smap_baseline where cast(zip5 as int) % 3 = 0
        """,
        "spliced": """
            select order_id, tracking_number, order_placed_date, zip5, units, sim_fc_name,
                   sim_carrier_code, sim_route, sim_tnt, sim_transit_cost
            from routing_baseline where zip5 not in (select zip5 from chosen)
            union all
            select order_id, tracking_number, order_placed_date, zip5, units, sim_fc_name,
                   sim_carrier_code, sim_route, sim_tnt, sim_transit_cost
            from routing_remediation where zip5 in (select zip5 from chosen)
        """,
        "before_after": """
            select b.*, s.sim_fc_name, s.sim_carrier_code
            from base b join spliced s
              on s.order_id = b.order_id and s.tracking_number = b.tracking_number
             and s.order_placed_date = b.order_placed_date and s.zip5 = b.zip5
        """,
    }
)


def proxied(source: str, fc: str, carrier: str) -> str:
    return f"""
        select order_placed_date, fc, carrier, package_count
        from (select n.order_placed_date, n.fc,
                     sum(round_even(n.packages * p.fdxhd_proxy, 0)) as FDXHD,
                     sum(round_even(n.packages * p.ontrgd_proxy, 0)) as ONTRGD
              from (select order_placed_date, {fc} as fc, {carrier} as carrier,
                           count(distinct tracking_number) as packages
                    from {source} group by all) n
              join wms_proxy p on p.fc = n.fc and p.proxy_carrier = n.carrier
               and p.dayofweek = dayofweek(n.order_placed_date)
              group by all)
        unpivot (package_count for carrier in (FDXHD, ONTRGD))
    """


STEPS["proxy_base"] = proxied("routing_baseline", "sim_fc_name", "sim_carrier_code")
STEPS["proxy_spliced"] = proxied("spliced", "sim_fc_name", "sim_carrier_code")


def share(source: str, keys: str, value: str, denom: str | None = None) -> str:
    over = f"partition by {denom}" if denom else ""
    return f"""
        select {keys}, value, sum(value) over ({over}) as total,
               round_even(value / sum(value) over ({over}) * 100, 4) as percent
        from (select {keys}, {value} as value from {source} group by all)
    """


def change(base: str, final: str, keys: str, value: str, denom: str | None = None) -> str:
    return f"""
        select {', '.join('b.' + k.strip() for k in keys.split(','))},
               b.value as base_value, b.percent as base_percent,
               i.value as iter_value, i.percent as iter_percent,
               i.percent - b.percent as abs_percent_change
        from ({share(base, keys, value, denom)}) b
        join ({share(final, keys, value, denom)}) i using ({keys})
    """


PACKAGES = "count(distinct tracking_number)"
