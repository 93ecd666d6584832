"""Types of records, plans, schemas and results. A plan is one struct with an arm per family; unused arms are null."""

from __future__ import annotations

TRIPLE = "struct<subject:string,predicate:string,object:string,subject_type:string,object_type:string>"
FIELD = "struct<row:string,column:string,value:string>"
REF = "struct<category:string,item:string>"
CLUE = f"struct<type:string,left:{REF},right:{REF},position:int>"
PAIR = "struct<aspect:string,sentiment:string>"
PLAN = (
    f"struct<domain:string,schema_id:string,triples:array<{TRIPLE}>,fields:array<{FIELD}>,grid_size:int,"
    f"categories:map<string,array<string>>,clues:array<{CLUE}>,assignment:map<string,map<string,int>>,pairs:array<{PAIR}>,others:boolean>"
)
ERROR = "struct<code:string,path:string,message:string>"
CONSTRAINTS = (
    f"struct<cardinality:array<int>,allowed_predicates:array<string>,allowed_triples:array<{TRIPLE}>,domain_range:map<string,array<string>>,"
    f"disjoint_types:array<array<string>>,allowed_columns:array<string>,required_fields:array<array<string>>,allowed_cells:array<array<string>>,"
    f"field_value_types:map<string,string>,allowed_values:map<string,array<string>>,grid_size:int,categories:map<string,array<string>>,clues:array<{CLUE}>,"
    f"allowed_aspects:array<string>,allowed_sentiments:array<string>,required_pairs:array<array<string>>,required_others:boolean>"
)
#: What records are stratified and grouped by; null where their family has no such thing.
STRATA = "category string, triple_count int, source string, schema_cardinality int, grid_size int, clue_count int, clue_type array<string>, puzzle_family string, n_star int"
RECORD = f"source_id string, dataset string, domain string, official_split string, schema_id string, reference_plan {PLAN}, reference_text string, record_sha256 string, {STRATA}"

# Domains, datasets, aspects and sentiments with their Vietnamese names, clue types, grid shapes.
TRIPLE_DOMAINS = ("webnlg",)
CELL_DOMAINS = ("dart",)
GRID_DOMAINS = ("zebra_easy", "zebra_medium", "zebra_hard")
REVIEW_DOMAINS = ("visfd",)
ASPECTS = {
    "BATTERY": "pin",
    "CAMERA": "camera",
    "DESIGN": "thiết kế",
    "FEATURES": "tính năng",
    "GENERAL": "tổng thể",
    "PERFORMANCE": "hiệu năng",
    "PRICE": "giá",
    "SCREEN": "màn hình",
    "SER&ACC": "dịch vụ và phụ kiện",
    "STORAGE": "bộ nhớ",
}
SENTIMENTS = {"Positive": "tích cực", "Neutral": "trung tính", "Negative": "tiêu cực"}
OTHER_ASPECT = "khía cạnh khác"
CLUE_TYPES = ("equality", "inequality", "left_of", "right_of", "adjacent", "not_adjacent", "fixed_position")
#: positions and categories
GRID_SHAPES = {"zebra_easy": (2, 3), "zebra_medium": (3, 4), "zebra_hard": (4, 5)}


def empty_plan(**arms: str) -> str:
    """A SQL struct of the PLAN type with the given arms as SQL expressions."""
    kinds = {"domain": "string", "schema_id": "string", "triples": f"array<{TRIPLE}>", "fields": f"array<{FIELD}>", "grid_size": "int", "categories": "map<string,array<string>>", "clues": f"array<{CLUE}>", "assignment": "map<string,map<string,int>>", "pairs": f"array<{PAIR}>", "others": "boolean"}
    return "named_struct(" + ", ".join(f"'{k}', CAST({arms.get(k, 'NULL')} AS {t})" for k, t in kinds.items()) + ")"
