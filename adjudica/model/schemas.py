"""Schemas of the claim tables as DDL, for readers; nothing is inferred."""

from __future__ import annotations

_DDL = {
    "claims": """claim_id bigint, facility_id int, department_id int, patient_account_number string, patient_name string, date_of_birth date,
        gender string, service_from_date date, service_to_date date, primary_diagnosis string, financial_class string, secondary_insurance string,
        procedure_code string, total_charge_amount decimal(12,2), processing_status string, processing_stage string, active boolean, priority string,
        correlation_id string, created_at timestamp, updated_at timestamp, raw_data string""",
    "claims_line_items": """claim_id bigint, line_number int, procedure_code bigint, modifier1 string, modifier2 string, modifier3 string, modifier4 string,
        units int, charge_amount decimal(12,2), service_from_date date, service_to_date date, diagnosis_pointer string, place_of_service string,
        revenue_code string, rvu_value decimal(10,4), reimbursement_amount decimal(14,4)""",
    "claims_diagnosis_codes": "claim_id bigint, diagnosis_sequence int, diagnosis_code string, diagnosis_type string",
    "rvu_data": """procedure_code bigint, description string, category string, subcategory string, work_rvu decimal(8,4), pe_rvu decimal(8,4),
        mp_rvu decimal(8,4), total_rvu decimal(8,4), conversion_factor decimal(8,2), effective_date date, end_date date, status string, updated_at timestamp""",
    "rvu_sync_log": "sync_id bigint, sync_type string, started timestamp, completed timestamp, records_processed bigint, sync_status string",
    "business_rules": """rule_name string, rule_type string, rule_logic string, severity_level string, is_active boolean, applies_to_facilities string,
        applies_to_financial_classes string, execution_count bigint, failure_count bigint""",
    "failed_claims": """claim_id bigint, patient_account_number string, facility_id int, failure_reason string, failure_category string, processing_stage string,
        failed_at timestamp, original_data string, repair_suggestions string, resolution_status string, assigned_to string, resolved_at timestamp,
        resolution_action string, resolution_notes string, potential_revenue_loss decimal(12,2), errors array<string>""",
    "dead_letter_queue": "dlq_id bigint, claim_id bigint, error_reason string, data string, inserted_at timestamp",
    "processing_checkpoints": "claim_id bigint, stage string, checkpoint_at timestamp",
    "batch_metadata": "batch_id bigint, total_claims bigint, processed_claims bigint, failed_claims bigint, started timestamp, completed timestamp, throughput double",
    "facilities": "facility_id int, facility_name string, active boolean, region_id int, beds int, city string, state string",
    "facility_region": "region_id int, region_name string, organization_id int",
    "facility_organization": "organization_id int, organization_name string",
    "facility_financial_classes": "facility_id int, financial_class string, payer_id int, reimbursement_rate decimal(5,4), processing_priority string, active boolean, effective_date date, end_date date",
    "audit_log": "audit_id bigint, table_name string, record_id string, operation string, user_id string, at timestamp, old_values string, new_values string, reason string",
    "daily_processing_summary": """summary_date date, facility_id int, claims bigint, failed bigint, lines bigint, charges decimal(22,2), reimbursement decimal(24,4),
        error_rate double, pass_rate double""",
}
SCHEMAS: dict[str, str] = {name: " ".join(ddl.split()) for name, ddl in _DDL.items()}
