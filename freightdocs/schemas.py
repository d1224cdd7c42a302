"""Declared shapes of the records that pass between the stages."""

from __future__ import annotations

from freightdocs.operators.issues import ISSUES_TYPE

CONTAINER_FIELDS = {
    "type": "string", "qty": "int", "container_no": "string", "seal_no": "string", "packages": "int",
    "packages_unit": "string", "gross_weight_kg": "double", "volume_cbm": "double", "po_no": "string",
    "mbl_no": "string", "remark": "string",
}
CONTAINER_TYPE = "struct<" + ",".join(f"{k}:{v}" for k, v in CONTAINER_FIELDS.items()) + ">"
CONTAINERS_TYPE = f"array<{CONTAINER_TYPE}>"
FACTORY_TYPE = "struct<name:string,address:string,contact:string,phone:string>"
MAPPING_TYPE = "struct<c_sn:string,mbl_no:string,hbl_no:string,c_title:string,factory_name:string,c_note:string>"
SOURCE_TYPE = "struct<file:string,doc_format:string,template_hint:string,extracted_at:string>"

# scalar fields of a record, in output order
TEXT_FIELDS = (
    "internal_ref", "customs_declaration_no", "customer_ref", "mbl_no", "hbl_no", "vessel", "voyage",
    "carrier", "pol", "pod", "transit_port", "terminal", "etd", "si_cutoff", "customs_cutoff",
    "loading_time", "customer", "shipper_company", "shipper_agent", "recipient", "doc_date", "sender",
    "sender_contact", "remark",
)
# (field, type) of the strict output
EXTRACTION = (
    ("doc_type", "string"),
    *((name, "string") for name in TEXT_FIELDS),
    ("containers", CONTAINERS_TYPE),
    ("factory", FACTORY_TYPE),
    ("order_mapping", MAPPING_TYPE),
    ("review_issues", ISSUES_TYPE),
    ("ready_for_order", "boolean"),
    ("source", SOURCE_TYPE),
    ("raw_text_snippet", "string"),
)

LOG_FIELDS = (
    "request_id string, ip string, x_forwarded_for string, user_agent string, method string, path string, "
    "file string, file_size bigint, body string, body_truncated boolean, status int, error_code string, "
    "error struct<code:string,message:string,details:string>, duration_ms double, ts timestamp"
)
