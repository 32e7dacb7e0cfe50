"""Test inputs as SQL over the given tables.

One statement per input table, in dependency order.  The text runs unchanged
in Spark and in DuckDB, so an operator and its SQL check see the same rows.
FIXTURES.md documents the shapes.
"""

RECIPES = {
    "fcs": """
        select * from (values
        (0,'AVP1'),(1,'AVP2'),(2,'BNA1'),(3,'CFC1'),(4,'CLT1'),(5,'DAY1'),(6,'DFW1'),(7,'HOU1'),(8,'MCI1'),(9,'MCO1'),(10,'MDT1'),(11,'PHX1'),(12,'RNO1'))
        t(fc_i, fc_name)
    """,
    "modes": """
        select * from (values (0,'FDXHD'),(1,'ONTRGD')) t(m_i, mode)
    """,
    "lines": """
        select l_orderkey as order_id, l_linenumber as order_line_id, cast(l_orderkey as string) ||
        '-' || cast(l_linenumber % 2 as string) as tracking_number, min(l_partkey) as part_id,
        min(l_suppkey) as supp_id, cast(max(l_quantity) as int) as qty, min(o_custkey) as custkey,
        cast(min(o_orderkey) % 14 as int) as day_i from lineitem join orders on l_orderkey =
        o_orderkey group by l_orderkey, l_linenumber
    """,
    "order_lines": """
        select order_id, tracking_number, order_line_id, qty, date '2025-11-01' + day_i as
        order_placed_date from lines
    """,
    "shipments": """
        select order_id, tracking_number, lpad(cast(z as string), 5, '0') as zip5, fc_name,
        carrier_code, carrier_code || '-' || fc_name as route, order_placed_ts, order_placed_ts +
        interval '6' hour * (order_id % 5) as release_ts, order_placed_ts + interval '12' hour * (1
        + order_id % 3) as actual_ship_ts, case when order_id % 17 = 0 then null else
        order_placed_ts + interval '12' hour * (1 + order_id % 3) + interval '8' hour * (3 +
        (order_id * 3 + z) % 10) end as first_attempt_ts, cast(order_placed_ts as date) + 3 as
        promised_date, 4.0 + part_id % 60 as length, 3.0 + supp_id % 32 as width, 2.0 + order_id %
        30 as height, 1.0 + sum_qty % 70 as weight, units from (select order_id, tracking_number,
        min(custkey) % 60 as z, min(part_id) as part_id, min(supp_id) as supp_id, sum(qty) as
        sum_qty, count(*) as units, case when (order_id * 7 + min(custkey)) % 5 < 2 and min(custkey)
        % 4 <> 3 then 'ONTRGD' else 'FDXHD' end as carrier_code, cast(date '2025-11-01' + min(day_i)
        as timestamp) + interval '1' hour * (order_id % 24) as order_placed_ts from lines group by
        order_id, tracking_number) p join fcs on fcs.fc_i = p.supp_id % 13
    """,
    "inventory": """
        select order_id, order_line_id, fc_name, cast((part_id * 31 + fc_i * 17) % 90 as int) as
        quantity_available from lines cross join fcs where (part_id + fc_i) % 3 <> 0
    """,
    "lane_grid": """
        select z, lpad(cast(z as string), 5, '0') as zip5, day_i, fc_i, fc_name, m_i, mode from
        (select distinct custkey % 60 as z from lines) a cross join (select distinct day_i from
        lines) b cross join fcs cross join modes
    """,
    "ship_map_raw": """
        select date '2025-11-01' + day_i as ship_date, fc_name as fc, zip5, mode, mode || '-' ||
        fc_name as routeid, cast(2 + (z + fc_i) % 7 as int) as zone, cast((16 + (z + fc_i) % 10) *
        10000 + 3000 as int) as cutoff, cast(1 + (z * 3 + fc_i * 5 + m_i) % 6 as int) as tnt, cast(1
        + (z * 3 + fc_i * 5 + m_i) % 6 as int) as adjtnt, cast(2 + (z * 3 + fc_i * 5 + m_i) % 6 as
        int) as nextadjtnt, date '2025-10-20' + g as generate_date, 'N' as item_type from lane_grid
        cross join (values (0),(1)) gg(g) where (z + fc_i) % 3 <> 1 and (m_i = 0 or z % 4 <> 3)
    """,
    "eligible_lanes": """
        select date '2025-11-01' + day_i as shipdate, fc_name as fcname, zip5, mode, mode || '-' ||
        fc_name as routeid, cast(2 + (z + fc_i) % 7 as int) as zone, '19:30:00' as cutoff, 2 as tnt,
        2 as adjtnt, 3 as nextadjtnt from lane_grid where m_i = 1 and z % 4 = 3 and (z + fc_i) % 3
        <> 1
    """,
    "base_rates": """
        select mode as carrier_code, cast(zone as int) as zone, cast(w as int) as bill_weight, (5.0
        + 0.3 * zone + 0.12 * w) * (1.0 - 0.08 * m_i) as base_charge, date '2025-01-01' as
        start_date, date '2025-12-31' as end_date from modes cross join (select distinct 2 + z % 7
        as zone from lane_grid) zz cross join (select distinct 1 + part_id % 149 as w from lines) ww
    """,
    "fuel": """
        select mode as carrier_code, 0.15 - 0.02 * m_i as fsc_per, date '2025-01-01' as start_dt,
        date '2025-12-31' as end_dt from modes
    """,
    "longest_bands": """
        select mode as carrier_code, zone, lo as longest_side_lower, hi as longest_side_upper,
        amount, charge_type, date '2025-01-01' as start_date, date '2025-12-31' as end_date from
        modes cross join (select distinct zone from base_rates) zz cross join (values (48.0, 60.0,
        12.0, 'additional_handling'), (60.0, 62.0, 60.0, 'oversize'), (62.0, 999.0, 300.0,
        'unauthorized_oversize')) t(lo, hi, amount, charge_type)
    """,
    "fc_zip_distance": """
        select fc_name, zip5 as postcode, 50.0 + (z * 37 + fc_i * 91) % 2400 as dist_miles from
        lane_grid where day_i = 0 and m_i = 0 and (z + fc_i) % 11 <> 0
    """,
    "wms_proxy": """
        select dayofweek, fc_name as fc, mode as proxy_carrier, case when m_i = 0 then 0.97 else 0.1
        end as fdxhd_proxy, case when m_i = 0 then 0.03 else 0.9 end as ontrgd_proxy from fcs cross
        join modes cross join (values (0),(1),(2),(3),(4),(5),(6)) d(dayofweek)
    """,
    "service_failures": """
        select cast(order_placed_ts as date) + 3 as unpadded_edd, fc_name as fc, carrier_code, zip5
        as zip, count(*) as total, sum(case when cast(first_attempt_ts as date) > promised_date then
        1 else 0 end) as failures from shipments where first_attempt_ts is not null group by 1, 2,
        3, 4
    """,
    "station_backlog": """
        select cast(ts as date) as run_date, case when user_id % 2 = 0 then 'FedEx' else 'OnTrac'
        end as carrier, cast(user_id % 30 as int) as dest_facility_num, value / 200.0 as
        days_behind, ts as row_created_date from events
    """,
    "station_zip_a": """
        select zip5 as zipcode, cast(7000 + z % 30 as string) as master_term, date '2024-01-01' + g
        as snapshot_date from (select distinct z, zip5 from lane_grid) q cross join (values (0),(1))
        gg(g) where z % 2 = 0 or z % 7 = 0
    """,
    "station_zip_b": """
        select zip5 as customer_zip, cast((z * 2 + 1) % 30 as int) as dest_facility_num from (select
        distinct z, zip5 from lane_grid) q where z % 5 <> 0
    """,
    "resi": """
        select mode as carrier_code, 0.5 + 0.25 * m_i as resi_amount, date '2025-01-01' as
        start_date, date '2025-12-31' as end_date from modes
    """,
    "das": """
        select mode as carrier_code, zip5 as zipcode, 1.5 + z % 3 as amount, date '2025-01-01' as
        start_date, date '2025-12-31' as end_date from (select distinct z, zip5, m_i, mode from
        lane_grid) q where (z + m_i) % 5 = 0
    """,
    "weight_bands": """
        select mode as carrier_code, zone, lo as weight_lower, hi as weight_upper, amount,
        charge_type, date '2025-01-01' as start_date, date '2025-12-31' as end_date from modes cross
        join (select distinct zone from base_rates) zz cross join (values (50.0, 68.0, 14.0,
        'additional_handling'), (68.0, 150.0, 320.0, 'unauthorized_oversize')) t(lo, hi, amount,
        charge_type)
    """,
    "second_bands": """
        select mode as carrier_code, zone, 30.0 as second_longest_side_lower, 999.0 as
        second_longest_side_upper, 11.0 as amount, 'additional_handling' as charge_type, date
        '2025-01-01' as start_date, date '2025-12-31' as end_date from modes cross join (select
        distinct zone from base_rates) zz
    """,
    "girth_bands": """
        select mode as carrier_code, zone, lo as length_plus_girth_lower, hi as
        length_plus_girth_upper, amount, charge_type, date '2025-01-01' as start_date, date
        '2025-12-31' as end_date from modes cross join (select distinct zone from base_rates) zz
        cross join (values (105.0, 130.0, 13.0, 'additional_handling'), (130.0, 160.0, 65.0,
        'oversize'), (160.0, 999.0, 310.0, 'unauthorized_oversize')) t(lo, hi, amount, charge_type)
    """,
    "peak": """
        select mode as shipmode, w as peak_surcharge_application_week, 0.4 + 0.2 * m_i as
        peak_surcharge from modes cross join (values (date '2025-11-03'), (date '2025-11-10')) t(w)
    """,
    "removal_zips": """
        select distinct z as zip5 from lane_grid where z % 10 = 1
    """,
    "shutdowns": """
        select zip5, mode as carrier_code, date '2025-11-15' + cast(z % 2 as int) as start_date,
        case when z % 9 = 0 then null else date '2025-11-16' + cast(z % 6 as int) end as end_date
        from (select distinct z, zip5, m_i, mode from lane_grid) q where (z + m_i) % 4 = 0
    """,
    "routed_packages": """
        select order_placed_ts + interval '1' hour * (order_id % 6) as batch_ts, fc_name, case when
        order_id % 9 = 0 then 'FDXHD ' else carrier_code end as ship_method, order_id, cast(units as
        double) as cartonization_id, case when order_id % 13 = 0 then 'FREIGHT' else 'NORMAL' end as
        itemtype from shipments
    """,
    "recommendation_history": """
        select zip5, case when z % 3 = 0 then 'activate' else 'deactivate' end as
        final_recommendation, cast(date '2025-10-01' + cast(z % 40 as int) + g as timestamp) as
        run_dttm, case when z % 8 = 0 then 'trial' else 'default' end as run_name, case when (z + g)
        % 6 = 0 then 'partial' else 'all' end as zip_count_tag, case when z % 4 = 0 then 'ok' when z
        % 4 = 1 then 'deactivate' else 'None' end as final_reason_dea, case when z % 4 = 0 then 'ok'
        else 'None' end as final_reason_shutdown, case when z % 4 = 0 then 'ok' when z % 4 = 2 then
        'deactivate' else 'None' end as final_reason_backlog, case when z % 2 = 0 then 'remediation'
        else 'expansion' end as source from (select distinct z, zip5 from lane_grid) q cross join
        (values (0),(7)) gg(g)
    """,
    "shipments_again": """
        select * from shipments union all select s.order_id, s.tracking_number, s.zip5, b.fc_name,
        case when s.carrier_code = 'FDXHD' then 'ONTRGD' else 'FDXHD' end as carrier_code,
        'second' as route, s.order_placed_ts, s.release_ts + interval '9' hour as release_ts,
        s.actual_ship_ts + interval '24' hour as actual_ship_ts, s.first_attempt_ts,
        s.promised_date, s.length + 20 as length, s.width, s.height, s.weight + 3 as weight,
        s.units + 1 as units from shipments s join fcs a on a.fc_name = s.fc_name join fcs b on
        b.fc_i = (a.fc_i + 3) % 13 where s.order_id % 3 = 0
    """,
    "longest_bands_two": """
        select * from longest_bands union all select carrier_code, zone, longest_side_lower - 2.0 as
        longest_side_lower, longest_side_upper, amount + 2.5 as amount, charge_type, start_date,
        date '2025-11-09' as end_date from longest_bands where zone % 2 = 0
    """,
    "resi_two": """
        select carrier_code, resi_amount, start_date, date '2025-11-06' as end_date from resi union
        all select carrier_code, resi_amount + 0.5 as resi_amount, date '2025-11-05' as start_date,
        date '2025-11-12' as end_date from resi
    """,
}
