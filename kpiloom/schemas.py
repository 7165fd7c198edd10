"""Declared schemas of the data model."""

from __future__ import annotations

from pyspark.sql.types import _parse_datatype_string as ddl  # noqa: PLC2701

PACK = "table_id string, doc_id string, year int, page int, bucket string, section_name string, title string, headers array<array<string>>, merged_headers array<string>, rows array<array<string>>, stub_col array<string>"

EVIDENCE = "struct<table_id:string,doc_id:string,page:int,section:string,title:string,row_idx:int,col_idx:int>"

#: Facts of the rule path; ``ord`` fields give first-appearance order.
FACT = f"kpi_name string, key string, value double, year int, units string, evidence {EVIDENCE}"

#: A KPI as a model or a prompt gives it; the value's lexeme is kept, since ids hash it.
KPI = "struct<name:string,key:string,units:string,value:string,year:int,row_name:string,row_idx:int,col_name:string,col_idx:int,source_model:string>"

EDGE = "source string, target string, year_diff int, edge_type string"

ENVELOPE = (
    "metadata struct<model:string,input_file:string,extraction_timestamp:string,num_tables_processed:int,job_id:string>, "
    f"tables array<struct<table_id:string,doc_id:string,year:int,section_name:string,title:string,extraction_timestamp:string,model:string,error:string,extraction_result:struct<kpis:array<{KPI}>>>>, "
    f"results array<struct<table_id:string,model:string,num_kpis:int,error:string,recovered:boolean,processing_timestamp:string,kpis:array<{KPI}>>>"
)

VALID_FILE = "source_file string, year string, valid_kpis array<struct<name:string,key:string,units:string,value:string,year:int,evidence:struct<table_id:string,row_idx:int,col_idx:int,row_name:string,col_name:string>>>"

__all__ = ["EDGE", "ENVELOPE", "EVIDENCE", "FACT", "KPI", "PACK", "VALID_FILE", "ddl"]
