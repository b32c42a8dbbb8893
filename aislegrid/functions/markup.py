"""Extraction from HTML and JSON texts. Regular parts are Column expressions; brace matching and walks over arbitrary JSON are Arrow functions."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def ld_blocks(html: Column) -> Column:
    """Bodies of all JSON-LD scripts."""
    return F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type=["\']?application/ld\+json["\']?[^>]*>(.*?)</script>'), F.lit(1))


def ld_products(html: Column) -> Column:
    """Structs (name, url, gtin, price) of the products in JSON-LD: single ones, of item lists and of @graph."""
    product = "struct<name:string,url:string,gtin13:string,sku:string,offers:struct<price:string,lowPrice:string>>"
    plain = F.transform(ld_blocks(html), lambda b: F.from_json(b, f"struct<`@type`:string,name:string,url:string,gtin13:string,sku:string,offers:struct<price:string,lowPrice:string>,itemListElement:array<struct<item:{product}>>,`@graph`:array<struct<`@type`:string,name:string,url:string,gtin13:string,sku:string,offers:struct<price:string,lowPrice:string>>>>"))

    def row(x: Column) -> Column:
        return F.struct(x["name"].alias("name"), x["url"].alias("url"), F.coalesce(x["gtin13"], x["sku"]).alias("gtin"), F.coalesce(x["offers"]["price"], x["offers"]["lowPrice"]).try_cast("double").alias("price"))

    none = F.array().cast("array<struct<name:string,url:string,gtin:string,price:double>>")
    own = F.transform(F.filter(plain, lambda x: x["@type"] == "Product"), row)
    listed = F.flatten(F.transform(plain, lambda x: F.coalesce(F.transform(x["itemListElement"], lambda i: row(i["item"])), none)))
    graph = F.flatten(F.transform(plain, lambda x: F.coalesce(F.transform(F.filter(x["@graph"], lambda g: g["@type"] == "Product"), row), none)))
    return F.concat(own, listed, graph)


def page_gtin(html: Column) -> Column:
    """Barcode of a product page: marked text, else JSON-LD codes of 8 to 14 digits, else a sku in a script."""
    marked = _found(html, r'(?is)class=["\'][^"\']*text-unicode[^"\']*["\'][^>]*>\s*([0-9]{8,14})\s*<')
    coded = _found(F.array_join(ld_blocks(html), " "), r'"(?:gtin13|sku|gtin12|gtin)"\s*:\s*"?([0-9]{8,14})"?')
    return F.coalesce(marked, coded, _found(html, r'"sku"\s*:\s*"([0-9]{8,14})"'))


def page_gtin_by_sku_block(html: Column) -> Column:
    """The variant whose last step is the product-sku block."""
    coded = _found(F.array_join(ld_blocks(html), " "), r'"(?:gtin13|sku|gtin12|gtin)"\s*:\s*"?([0-9]{8,14})"?')
    return F.coalesce(coded, _found(html, r'(?is)class=["\'][^"\']*product-sku[^"\']*["\'][^>]*>[^0-9<]*([0-9]{8,14})'))


def page_price(html: Column) -> Column:
    """Price of a product page: sale price meta, JSON-LD offers, price meta, twitter, class."""
    meta = lambda name: _found(html, rf'(?is)<meta[^>]*(?:property|name)=["\']{name}["\'][^>]*content=["\']([0-9.]+)["\']')
    offer = _found(F.array_join(ld_blocks(html), " "), r'"(?:price|lowPrice)"\s*:\s*"?([0-9.]+)"?')
    return F.coalesce(meta("product:sale_price:amount"), offer, meta("product:price:amount"), meta("twitter:data1"), _found(html, r'(?is)class=["\'][^"\']*price[^"\']*["\'][^>]*>[^0-9<]*([0-9.]+)')).try_cast("double")


def table_rows(html: Column) -> Column:
    """Structs (name, measure, popularity) of the table that has a "Product Name" column: rows of three and more cells, without the header."""
    table = _found(html, r"(?is)(<table(?:(?!</table>).)*Product Name.*?</table>)")
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", ""))))
    full = F.filter(cells, lambda c: F.size(c) >= 3)
    return F.transform(full, lambda c: F.struct(F.get(c, F.lit(0)).alias("name"), F.get(c, F.lit(1)).alias("measure"), F.get(c, F.lit(2)).try_cast("int").alias("popularity")))


def _arrow_texts(column: Column, one) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else one(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<string>")(column)


def objects_around(text: Column, marker: str) -> Column:
    """The smallest valid JSON objects that enclose each occurrence of a marker, each once."""

    def one(t: str) -> list[str]:
        decoder, found = json.JSONDecoder(), {}
        at = t.find(marker)
        while at >= 0:
            start = t.rfind("{", 0, at + 1)
            while start >= 0:
                try:
                    _, end = decoder.raw_decode(t, start)
                except ValueError:
                    end = -1
                if end > at:
                    found[t[start:end]] = None
                    break
                start = t.rfind("{", 0, start)
            at = t.find(marker, at + 1)
        return list(found)

    return _arrow_texts(text, one)


def product_nodes(text: Column) -> Column:
    """JSON texts of the topmost nodes that have an id, a name and a price, in depth-first order."""

    def one(t: str) -> list[str]:
        try:
            pending = [json.loads(t)]
        except ValueError:
            return []
        out = []
        while pending:
            node = pending.pop()
            if isinstance(node, dict):
                if all(k in node for k in ("id", "name", "price")):
                    out.append(json.dumps(node, ensure_ascii=False, sort_keys=True))
                    continue
                pending += reversed(list(node.values()))
            elif isinstance(node, list):
                pending += reversed(node)
        return out

    return _arrow_texts(text, one)


def offer(json_text: Column) -> Column:
    """Struct (price, promo): the first positive price of several paths; promo where an offer is below it."""
    value = lambda path: F.get_json_object(json_text, path).try_cast("double")
    positive = [F.when(value(p) > 0, value(p)) for p in ("$.price", "$.unitPrice", "$.pricing.price", "$.pricing.amount", "$.price.value")]
    price, original, special = F.coalesce(*positive), value("$.originalPrice"), value("$.offerPrice")
    return F.struct(F.coalesce(F.when(original > price, original), price).alias("price"), F.when(original > price, price).when(special < price, special).alias("promo"))


def tags(json_text: Column, path: str, text_path: str, keywords: list[str]) -> Column:
    """Distinct tags of an array, else of a comma or semicolon list, else the keywords that the text has."""
    listed = F.from_json(F.get_json_object(json_text, path), "array<string>")
    split = F.filter(F.transform(F.split(F.get_json_object(json_text, path), "[,;]"), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    text = F.lower(F.coalesce(F.get_json_object(json_text, text_path), F.lit("")))
    guessed = F.array_compact(F.array(*[F.when(text.contains(k), F.lit(k)) for k in keywords]))
    return F.array_distinct(F.coalesce(F.when(F.size(listed) > 0, listed), F.when(F.size(split) > 0, split), guessed))
