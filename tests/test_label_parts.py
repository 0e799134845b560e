"""XML labels are parsed once each."""

from tessella.sources import labels


def test_first_elements_and_axes_of_a_label(spark):
    text = """<?xml version="1.0" encoding="UTF-8"?><p:P xmlns:p="http://x"><p:file_name>a<b>.img</b></p:file_name><file_name>late</file_name><p:sun_elevation> </p:sun_elevation>
    <p:Axis_Array><p:elements>7</p:elements><p:axis_name>Sample</p:axis_name></p:Axis_Array><p:Axis_Array><p:axis_name>Line</p:axis_name><p:elements>5</p:elements></p:Axis_Array></p:P>"""
    assert labels.label_values(text) == {"file_name": "a.img", "sun_elevation": " ", "Sample": "7", "Line": "5"} and labels.label_values(None) == {}
    got = labels.pds4_fields(spark.createDataFrame([("d/a.xml", text), ("d/b.xml", None)], "path string, value string")).orderBy("path").collect()
    assert (got[0].product_id, got[0].file_name, got[0].samples, got[0].lines, got[0].bands, got[0].sun_elevation, got[0].corners) == ("a", "a.img", 7, 5, None, None, None)
    assert got[1].file_name is None and got[1].lines is None
