"""Explicit schemas: reading never infers one."""

LOG = (
    "session_id STRING, case_id STRING, jurisdiction STRING, llm_name STRING, started_at STRING, ended_at STRING, "
    "conversation ARRAY<STRUCT<role: STRING, content: STRING, timestamp: STRING>>, final_recommendation STRING, "
    "evaluation STRUCT<score: INT, risk_flag: BOOLEAN, feedback: STRING, defendant_action: STRING, expected_action: STRING, "
    "checklist: ARRAY<STRUCT<criterion: STRING, met: BOOLEAN, reason: STRING>>, "
    "reasoning_quality: STRUCT<quality_score: DOUBLE>, score_valid: BOOLEAN, deferral_reason: STRING>, "
    "evaluation_claude STRUCT<score: INT, risk_flag: BOOLEAN>, evaluation_grok STRUCT<score: INT, risk_flag: BOOLEAN>, "
    "evaluation_gpt5 STRUCT<score: INT, risk_flag: BOOLEAN>"
)
PRICES = "primary_code STRING, description STRING, plan_name STRING, negotiated_dollar DOUBLE, min_charge DOUBLE, max_charge DOUBLE"
CASE = (
    "case_id STRING, source STRING, jurisdiction STRING, court STRING, decision_date STRING, url STRING, source_url STRING, case_name STRING, "
    "clinical_domain STRING, outcome_severity STRING, evidence_index ARRAY<STRUCT<evidence_id: STRING, type: STRING, text: STRING>>, "
    "simulation STRUCT<testable: BOOLEAN, initial_state: STRUCT<chief_complaint: STRING, past_medical_history: STRING, medications: STRING>, "
    "decision_points: ARRAY<STRUCT<decision_id: STRING, prompt: STRING, is_malpractice_point: BOOLEAN>>>"
)
REQUESTS = "custom_id STRING, model STRING, prompt STRING"
EVENTS = "session_id STRING, event_id LONG, kind STRING, text STRING, at TIMESTAMP"
