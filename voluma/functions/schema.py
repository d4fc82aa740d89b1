"""The column type of a 3D value.

Everything that can be answered without the coordinates is a plain field, so that Catalyst reads, prunes and
pushes it down to Parquet: bounds, counts, reference system and validation.
"""

from __future__ import annotations

from voluma.kernel.flat import LISTS

BBOX = "struct<min_x:double,min_y:double,min_z:double,max_x:double,max_y:double,max_z:double>"
COUNTS = "struct<vertices:int,solids:int,shells:int,faces:int,rings:int,triangles:int>"
VALIDATION = (
    "struct<open_edges:int,non_manifold_edges:int,degenerate_faces:int,orientation_errors:int,non_manifold_vertices:int,"
    "disconnected_shells:int,self_intersections:int,is_valid:boolean,is_closed:boolean,is_manifold:boolean,is_oriented:boolean>"
)
G3D = (
    f"struct<kind:int,crs:string,bbox:{BBOX},counts:{COUNTS},xs:array<double>,ys:array<double>,zs:array<double>,"
    + "".join(f"{name}:array<int>," for name in LISTS)
    + f"validation:{VALIDATION}>"
)
FACE = f"struct<face:int,solid:int,shell:int,polygon:{G3D}>"
REPORT = (
    "struct<is_valid:boolean,is_closed:boolean,is_manifold:boolean,is_oriented:boolean,solid_count:bigint,shell_count:bigint,face_count:bigint,"
    "open_edge_count:bigint,non_manifold_edge_count:bigint,degenerate_face_count:bigint,orientation_error_count:bigint,"
    "non_manifold_vertex_count:bigint,disconnected_shell_count:bigint,self_intersection_count:bigint,code:string,message:string>"
)
