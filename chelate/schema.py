"""Schemas of molecules and records."""

ATOM = "struct<idx:int,element:string,x:double,y:double,z:double>"
BOND = "struct<i:int,j:int,bo:float>"
MOLECULE = f"mol_id string, seq bigint, atoms array<{ATOM}>, bonds array<{BOND}>, properties map<string,double>"
#: Prediction records; topk is a list of [token, probability] pairs, read as text.
PREDICTION = "id string, task string, correct_top1 boolean, correct_top5 boolean, y_true struct<donor_atom:string,structure_token:string>, `group` struct<metal_element:string,cn:int>, pred struct<top1_prob:double,topk:array<array<string>>>"
DONOR_SAMPLE = "id string, masked string, mask_positions array<int>, target_token string, meta struct<metal:string,cn:int,geom:string>"
STRUCTURE_SAMPLE = "id string, masked string, mask_positions array<int>, target_tokens array<string>, meta struct<metal:string,cn:int,geom:string>"
CORRUPTION = "id string, clean string, corrupted string, corruption_type string, was_valid_before_corruption boolean, is_valid_after_corruption boolean"
CONVERTED = "source_id string, metal string, cn int, canonical string, valid boolean"
