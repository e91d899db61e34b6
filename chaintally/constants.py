"""Fixed values of the ledger domain."""

# The two addresses that hold no owner's funds.
ZERO_ADDRESS = "0x0000000000000000000000000000000000000000"
DEAD_ADDRESS = "0x000000000000000000000000000000000000dead"
SINK_ADDRESSES = (ZERO_ADDRESS, DEAD_ADDRESS)

# Call kinds that carry no value of their own.
VALUELESS_CALL_TYPES = ("delegatecall", "staticcall", "callcode")

# Decimal places of the native coin and of gas prices quoted in gwei.
WEI_DECIMALS = 18
GWEI_DECIMALS = 9

# Fixed value: the half-width, in standard errors, of a 99 % confidence band.
CONFIDENCE_Z = 2.58

# Reference lines drawn next to the concentration index.
HHI_LINES = (0.01, 0.15, 0.25)

ADDRESS_PAGE = "https://etherscan.io/address/"
NFT_PAGE = "https://etherscan.io/nft/"
