"""Analytics over daily air-quality readings, as Spark DataFrame operators."""

from airq.operators.catalog import (
    dataset_profile,
    default_filters,
    list_pollutants,
    list_states,
    list_years,
)
from airq.operators.explore import (
    check_selection,
    filter_readings,
    filtered_histogram,
    filtered_kpis,
    filtered_monthly_mean,
    filtered_status_counts,
    is_empty,
    preview_count,
    preview_rows,
    slice_kpis,
    state_comparison,
    value_histogram,
)
from airq.operators.overview import (
    best_state,
    monthly_mean,
    national_kpis,
    pollutant_share,
    severe_share,
    status_counts,
    status_pie_share,
    status_share_table,
    worst_area,
    worst_state,
)
from airq.operators.pollutants import (
    pollutant_facts,
    pollutant_mean,
    pollutant_status_matrix,
    season_pollutant_grid,
    season_pollutant_share,
    season_pollutant_wide,
    state_pollutant_counts,
    state_pollutant_share,
    top_pollutants,
)
from airq.operators.regions import (
    area_ranking,
    bottom_areas,
    state_area_ranking,
    state_cards,
    state_month_profile,
    state_ranking,
    state_slice,
    state_status_breakdown,
    top_areas,
)
from airq.operators.sites import merge_bitmaps, site_bitmaps, site_codes, site_counts
from airq.operators.summary import (
    merge_sums,
    partial_sums,
    reproducible_means,
    rollup_sums,
    snapshot_sums,
    summary_report,
)
from airq.operators.trends import (
    annual_summary,
    annual_summary_text,
    month_status_share,
    month_status_stack,
    month_status_wide,
    season_mean,
    season_status_share,
    season_status_stack,
    season_status_wide,
    year_month_matrix,
    year_month_mean,
)
from airq.sources.readings import clean, clean_readings, read_readings
from airq.sources.footers import footer_profile, from_footers
from airq.sources.snapshots import load_snapshot, refresh
from airq.sources.store import load_readings, stored, write_readings

