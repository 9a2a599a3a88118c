"""Schemas of the memory tables."""

from __future__ import annotations

CHUNK_DDL = """
  id string, content string, stream string, level int, score double, timestamp bigint,
  last_decay bigint, updated_at bigint, valid_from bigint, valid_until bigint, deleted_at bigint,
  last_implicit_boost bigint, last_rated_at bigint,
  consolidated boolean, dormant boolean, in_progress boolean, persistent boolean, is_latest boolean,
  source_ids array<string>, metadata string, importance double, access_count bigint, version bigint,
  harmful_count bigint, n_ratings bigint, alpha double, beta double,
  superseded_by string, supersedes_id string, root_memory_id string,
  trust_level string, provenance string,
  meta struct<fact_type:string,subject:string,event_date:string,confidence:double,topic:string,attributed_to:string>,
  source struct<agent:string,session:string,channel:string>
"""

# One flat nullable row per event line; `type` tells which fields are filled.
EVENT_DDL = """
  timestamp bigint, type string, stream string, query string, top1 double, result_count bigint,
  chunk_count bigint, kind string, cost_usd double, model string, tokens_in bigint, tokens_out bigint,
  _corrupt_record string
"""

# The five fact types of the memory row.
FACT_TYPES = ["preference_or_decision", "project_state", "fact", "event", "experience"]
