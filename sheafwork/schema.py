"""Row shapes that the sources emit and the plans read.

A block is one row: ``type`` says which columns mean something. Lists and nested
values are flattened in reading order with a depth, which keeps the tree.
"""

TYPES = ("heading", "paragraph", "list", "table", "code", "quote", "image", "rule", "page_break", "key_values", "raw")

ITEM = "struct<depth:int,text:string,checked:boolean>"
PAIR = "struct<k:string,v:string>"
#: level: of headings. page: where known. label: of page breaks. lang: of code. ordered, items: lists. src: images.
BLOCK = (
    "type string, text string, level int, page int, label string, lang string, ordered boolean, "
    f"items array<{ITEM}>, header array<string>, rows array<array<string>>, caption string, kv array<{PAIR}>, src string"
)
BLOCK_NAMES = [part.strip().split()[0] for part in ("type,text,level,page,label,lang,ordered,items,header,rows,caption,kv,src").split(",")]
BLOCK_STRUCT = (
    "struct<type:string,text:string,level:int,page:int,label:string,lang:string,ordered:boolean,"
    f"items:array<{ITEM}>,header:array<string>,rows:array<array<string>>,caption:string,kv:array<{PAIR}>,src:string>"
)
#: Pages as lines. number: of the last page; tables: of a page, from the top; outline: entries of the table of contents, each page and folded title once.
LAYOUT = (
    "struct<number:int,lines:array<struct<page:int,line_no:int,y:double,size:double,bold:boolean,text:string>>,"
    f"tables:array<struct<page:int,y:double,block:{BLOCK_STRUCT}>>,outline:array<struct<page:int,title:string,level:int>>>"
)
DOCUMENT = (
    "title string, title_source string, passthrough boolean, metadata string, warnings array<string>, error struct<code:string,message:string>, "
    f"blocks array<{BLOCK_STRUCT}>, assets array<struct<asset_id:string,filename:string,media_type:string,data:binary,width:int,height:int>>, layout {LAYOUT}"
)
