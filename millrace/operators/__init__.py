"""Pipeline operators, their registry, and the policy that bounds them."""
