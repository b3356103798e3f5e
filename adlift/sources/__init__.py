"""Sources and sinks: typed schemas, the driver-table mapping, CSV/parquet files."""

from adlift.sources.mapped import CampaignTables, campaign_tables  # noqa: F401
