"""Schemas and constants, in one place."""

from __future__ import annotations

IMAGES = "image_id long, width int, height int, data binary"
PIXELS = "image_id long, x int, y int, r int, g int, b int"
BOX = "struct<left:double,top:double,width:double,height:double>"
CLAIMS = "summary string, claims array<struct<claim:string,kind:string,box:" + BOX + ",confidence:double,evidence:string>>, text_items array<struct<text:string,box:" + BOX + ",confidence:double,legible:boolean>>, counts map<string,double>, observations array<string>, unreadable array<string>, abstained array<struct<question:string,reason:string>>"
OCR = "struct<text:string,confidence:double,blocks:array<struct<paragraphs:array<struct<lines:array<struct<text:string,words:array<struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>>>>>>>>"
CHUNK = "response string, done boolean, error string, eval_count long, prompt_eval_count long, load_duration long, eval_duration long"

# Fixed values of the measurement: thresholds in pixels, 8-bit colour distance, shares of a region, ratios.
INK_THRESHOLD, MIN_INK_AREA, MAX_COMPONENTS = 4, 6, 4000
TILE, NOISE_K, MAD_SCALE = 48, 4, 1.4826
TEXT_COMPONENTS, TEXT_MEAN, TEXT_PARENT_SHARE = 3, 100, 0.5
COLOUR_FLOOR, CLUSTER_TOLERANCE = 8, 16
PLATEAU_QUANT, PLATEAU_SHARE, PLATEAU_MERGE, PLATEAU_FLATNESS = 8, 0.02, 12, 0.85
PLATEAU_DOMINANCE, RING_HOLE, PLATEAU_BLOB = 0.6, 0.12, 0.004
SECOND_INK_MEAN, BLEND_PIXELS, PARENT_BOX_SHARE = 20, 500, 0.2
SOLID_FILL, SIZE_VARIATION, THIN_SIDE = 0.85, 0.5, 4
GOOD_FIT, ADEQUATE_FIT, FIT_TOLERANCE = 0.8, 0.5, 8
NOISE_CEILING, REGION_CONTRAST, REGION_SHARE, REGION_FILL = 1.25, 1.5, 0.02, 0.9
BOX_TOLERANCE, BOX_AREA, BOX_WIDTH, BOX_HEIGHT, MASK_AREA, MASK_COMPONENTS = 24, 200, 40, 30, 20, 512
LEGIBLE_SIDE, LEGIBLE_PIXELS = 256, 65536
RESPONSE_CHARS, LOAD_WINDOW_MS = 12000, 20_000
UPLOAD_WINDOW_MS, UPLOAD_LIMIT, TTL_MS = 60_000, 10, 15 * 60_000
