"""Schemas of the engine's rows, as DDL; ragged records are wide and nullable."""

HEADINGS = "array<struct<level:int,text:string,id:string>>"
LISTS = "array<struct<type:string,items:array<string>>>"
CODE_BLOCKS = "array<struct<language:string,code:string,source:string>>"
TABLES = "array<struct<headers:array<string>,rows:array<array<string>>>>"
IMAGES = "array<struct<src:string,alt:string,title:string>>"
SECTIONS = "array<struct<title:string,level:int,content:string>>"
ELEMENTS = f"struct<headings:{HEADINGS},lists:{LISTS},code_blocks:{CODE_BLOCKS},tables:{TABLES},images:{IMAGES}>"

CONTENT = (
    f"title string, content string, metadata map<string,string>, elements {ELEMENTS}, api_sections {SECTIONS}, "
    "success boolean, extraction_method string, error string"
)
LINK = (
    "url:string,text:string,type:string,priority:double,depth:int,source_selector:string,is_active:boolean,is_heading:boolean,"
    "container_type:string,section_title:string,group_ix:int,seq:int"
)
LINKS = f"array<struct<{LINK}>>"


def page_result(content: bool = True, links: bool = True) -> str:
    """What the page pass returns, with the parts that are asked for."""
    return "page_id bigint, url string" + (f", {CONTENT}" if content else "") + (f", links {LINKS}" if links else "")
