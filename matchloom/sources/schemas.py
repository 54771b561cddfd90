"""Row schemas shared by readers, writers and operators (DDL strings)."""

EXPLANATION = (
    "struct<matched_skills:array<string>, missing_skills:array<string>, "
    "matched_terms:array<struct<term:string, weight:double>>, overlap_score:double>"
)
SCORES = (
    "struct<bi_encoder:double, cross_encoder:double, cross_encoder_probability:double, skill_overlap:double>"
)
JOB_MATCH = (
    "struct<job_id:bigint, job_title:string, description:string, skills:string, job_category:string, "
    "job_family:string, bi_encoder_score:double, cross_encoder_score:double, "
    f"scores:{SCORES}, explanation:{EXPLANATION}, retrieval_rank:int, rank:int>"
)
FILTERS = "struct<job_families:array<string>, min_score:double>"
IMPORT_ENTRY = (
    "struct<created_at:bigint, label:string, resume_text:string, top_k:int, top_n:int, "
    f"filters:{FILTERS}, results:array<{JOB_MATCH}>>"
)
REQUEST_LOG = "request_id string, method string, path string, status int, took_ms double"
